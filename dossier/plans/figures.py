"""Totals over many documents for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import figures as G
from dossier.plans.search import hybrid_search
from dossier.session import cut_lineage


def keyword_hits(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(question_id, doc_id)`` hit by the keywords; not filtered by type or date.

    ``questions`` carry ``keywords`` and their ``embedding``; ``chunks`` carry ``doc_id``.
    """
    asked = questions.where(F.coalesce("keywords", F.lit("")) != "").select(
        F.col("question_id").alias("query_id"), F.col("keywords").alias("text"), "embedding"
    )
    hits = hybrid_search(asked, chunks, top=K.NARROW_TOP, pool=K.NARROW_POOL, keep=["doc_id"])
    return hits.select(F.col("query_id").alias("question_id"), "doc_id").distinct()


def aggregate_figures(
    questions: DataFrame, docs: DataFrame, *, chunks: DataFrame | None = None,
    max_docs: int | None = None, text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Totals per question, and the evidence rows behind them.

    ``questions``: question_id, agg, doc_type, date_from, date_to, keyword, pattern and, when
    ``chunks`` are given for narrowing, keywords and embedding. All documents that qualify are
    read unless ``max_docs`` is set; ``truncated`` and ``narrowed`` tell where documents were left out.
    """
    pairs = G.candidates(questions, docs, max_docs)
    scanned = pairs
    if chunks is not None:
        scanned = G.narrow(pairs, keyword_hits(questions, chunks))
    # Both results and the counts start from these rows.
    scanned = cut_lineage(scanned)
    found = cut_lineage(G.extract_figures(scanned, questions, docs, text=text).where("found"))
    totals = G.totals(questions, scanned, found)
    return totals, G.evidence(questions, found, docs)
