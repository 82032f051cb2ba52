"""Citations found in document text, resolved against the corpus, and the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import strip
from dossier.operators.fuzzy import fuzzy_topk


def extract_citations(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    span: str = K.CITATION_SPAN,
    code: str = K.CITATION_CODE,
    shown_chars: int = K.CITATION_CHARS,
) -> DataFrame:
    """``(doc_id, pos, ref_text, shown, code)``: every span that names a code, numbered within its text.

    ``ref_text`` is the whole span; ``shown`` is its opening, for display only.
    """
    spans = F.regexp_extract_all(F.col(text), F.lit(f"(?iu){span}"), F.lit(0))
    # Stripped per element: as a higher-order function the search runs once per text.
    found = docs.select(doc_id, F.posexplode(F.transform(spans, strip)).alias("pos", "_span"))
    return (
        found.withColumn("code", F.regexp_extract("_span", f"(?iu){code}", 1))
        .where(F.col("code") != "")
        .select(doc_id, "pos", F.col("_span").alias("ref_text"), F.left("_span", F.lit(shown_chars)).alias("shown"), "code")
    )


def resolve_citations(
    citations: DataFrame, corpus: DataFrame, *, key: str = "doc_no", corpus_id: str = "doc_id",
    details: tuple[str, ...] = (), **options,
) -> DataFrame:
    """Every citation with ``found`` and ``suggestions`` (best three corpus rows, best first)."""
    matches = fuzzy_topk(
        citations.select("code"), corpus, probe="code", key=key, corpus_id=corpus_id, **options
    )
    if details:
        shown = corpus.select(F.col(corpus_id).alias("match_id"), *details)
        matches = matches.join(shown, "match_id")
    item = F.struct(
        "match_rank", "match_id", "match", F.round("similarity", 6).alias("similarity"), *details
    )
    grouped = matches.groupBy("code").agg(F.array_sort(F.collect_list(item)).alias("suggestions"))
    return citations.join(grouped, "code", "left").withColumn(
        "found", F.col("suggestions").isNotNull()
    )


def citation_edges(
    citations: DataFrame, corpus: DataFrame, *, doc_id: str = "doc_id", key: str = "doc_no",
    corpus_id: str = "doc_id", **options,
) -> DataFrame:
    """``(child_id, parent_ref_text, parent_code, parent_id)``, one row per child and reference text.

    The parent is the best match other than the child itself, or null.
    """
    matches = fuzzy_topk(
        citations.select("code"), corpus, probe="code", key=key, corpus_id=corpus_id, **options
    ).select("code", "match_id", "match_rank")
    once = (
        citations.groupBy(doc_id, "ref_text")
        .agg(F.min_by("code", "pos").alias("code"))
        .withColumnRenamed(doc_id, "child_id")
    )
    candidates = once.join(matches, "code", "left")
    other = F.when(F.col("match_id") != F.col("child_id"), F.struct("match_rank", "match_id"))
    return candidates.groupBy("child_id", "ref_text", "code").agg(
        F.min(other)["match_id"].alias("parent_id")
    ).select(
        "child_id", F.col("ref_text").alias("parent_ref_text"),
        F.col("code").alias("parent_code"), "parent_id",
    )
