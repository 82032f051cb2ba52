"""Citation checks: draft by draft, and the edge table of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dossier.operators.citations import citation_edges, extract_citations, resolve_citations


def check_citations(drafts: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """Every citation of every draft with ``found`` and up to three suggestions."""
    return resolve_citations(
        extract_citations(drafts), corpus, details=("issued_on", "subject"), **options
    )


def corpus_edges(docs: DataFrame, **options) -> DataFrame:
    """Edges child -> cited document over the corpus itself; ``docs``: doc_id, doc_no, text."""
    return citation_edges(extract_citations(docs), docs.select("doc_id", "doc_no"), **options)
