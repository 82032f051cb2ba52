"""Fusion of ranked lists, second-stage ranking, and the texts built from the result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import tokens
from dossier.session import written


def rrf(
    dense: DataFrame,
    sparse: DataFrame,
    top: int,
    *,
    constant: int = K.RRF_CONSTANT,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
) -> DataFrame:
    """``(query_id, chunk_id, rrf_score, fused_rank)``: reciprocal ranks added over both lists."""

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(rank)), F.lit(0.0))

    both = dense.join(sparse, [query_id, chunk_id], "full_outer").select(
        query_id, chunk_id, (part("dense_rank") + part("sparse_rank")).alias("rrf_score")
    )
    order = Window.partitionBy(query_id).orderBy(F.desc("rrf_score"), F.asc(chunk_id))
    return both.withColumn("fused_rank", F.row_number().over(order)).where(
        F.col("fused_rank") <= top
    )


def query_term_share(query_text: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds, in [0, 1]."""
    wanted = F.array_distinct(tokens(query_text))
    found = F.size(F.array_intersect(wanted, tokens(text)))
    return F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(F.lit(0.0))


def rerank(
    pool: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    top: int,
    *,
    score: Callable[[Column, Column], Column] = query_term_share,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    text: str = "text",
    query_text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Pool ordered anew by ``score(query text, chunk text)``; equal scores keep their order.

    Result: ``(query_id, rank, chunk_id, text, score, *keep)``.
    """
    # Written, so that the few chunks of the pool are sent to the texts and no text is shuffled to be left out.
    pool = written(pool.select(query_id, chunk_id, "fused_rank"), "pool")
    q = queries.select(query_id, F.col(query_text).alias("_query_text"))
    # As a predicate, the cut to the pool goes below the joins that ``chunks`` is made of; as a join it need not.
    c = chunks.where(F.col(chunk_id).isin(pool.select(chunk_id).distinct())).select(chunk_id, F.col(text).alias("text"), *keep)
    scored = (
        pool.join(c, chunk_id)
        .join(q, query_id)
        .withColumn("score", score(F.col("_query_text"), F.col("text")))
    )
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc("fused_rank"))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select(query_id, "rank", chunk_id, "text", "score", *keep)
    )


def rerank_by_table(
    pool: DataFrame, scores: DataFrame, top: int, *, query_id: str = "query_id", chunk_id: str = "chunk_id"
) -> DataFrame:
    """The same cut with scores that an outside model wrote as ``(query_id, chunk_id, score)``."""
    order = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("score"), F.asc("fused_rank"))
    return (
        pool.join(scores, [query_id, chunk_id], "left")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )


def _or_missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(K.MISSING_MARK))


def _joined(passage: Column, separator: str = "") -> Column:
    """Passages of one query in rank order; a query has at most ``top`` of them."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", passage.alias("p"))))
    return F.array_join(F.transform(ordered, lambda s: s["p"]), separator)


def context(
    queries: DataFrame, hits: DataFrame, *, query_id: str = "query_id",
    number: str = "doc_no", date: str = "issued_on",
) -> DataFrame:
    """``(query_id, context, found)``: numbered passages, or the fixed sentence without hits."""
    passage = F.format_string(
        K.PASSAGE_FORMAT, F.col("rank"), _or_missing(number), _or_missing(date), F.col("text")
    )
    built = hits.groupBy(query_id).agg(_joined(passage).alias("context"))
    return queries.select(query_id).join(built, query_id, "left").select(
        query_id,
        F.coalesce("context", F.lit(K.NOT_FOUND_TEXT)).alias("context"),
        F.col("context").isNotNull().alias("found"),
    )


def draft_context(
    drafts: DataFrame, hits: DataFrame, *, query_id: str = "query_id", number: str = "doc_no",
    passage_chars: int | None = None,
) -> DataFrame:
    """Passages to hold against a draft, one per line; '' where the corpus has none."""
    text = F.col("text") if passage_chars is None else F.left("text", F.lit(passage_chars))
    passage = F.format_string(K.DRAFT_PASSAGE_FORMAT, _or_missing(number), text)
    built = hits.groupBy(query_id).agg(_joined(passage, "\n").alias("context"))
    return drafts.select(query_id).join(built, query_id, "left").select(
        query_id, F.coalesce("context", F.lit("")).alias("context")
    )


def sources(
    queries: DataFrame, hits: DataFrame, metadata: Sequence[str], *, query_id: str = "query_id"
) -> DataFrame:
    """``(query_id, sources)``: JSON array of text, metadata and score in rank order."""
    item = F.struct("text", F.struct(*metadata).alias("metadata"), "score")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.to_json(item).alias("p"))))
    joined = F.concat(
        F.lit("["), F.array_join(F.transform(ordered, lambda s: s["p"]), ","), F.lit("]")
    )
    built = hits.groupBy(query_id).agg(joined.alias("sources"))
    return queries.select(query_id).join(built, query_id, "left").select(
        query_id, F.coalesce("sources", F.lit("[]")).alias("sources")
    )
