"""Corpus statistics and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K


def totals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: number of documents and of chunks."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    n_chunks = chunks.agg(F.count(F.lit(1)).alias("n"))
    return docs.sparkSession.range(1).select(
        n_docs.scalar().alias("total_docs"), n_chunks.scalar().alias("total_chunks")
    )


def count_by(docs: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most first."""
    return (
        docs.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc(column))
    )


def count_by_each(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(dimension, value, cnt)`` for several columns in one scan (grouping sets)."""
    sets = [[F.col(c)] for c in columns]
    dimension = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    return (
        docs.select(*columns)
        .groupingSets(sets, *columns)
        .agg(F.count(F.lit(1)).alias("cnt"), dimension.alias("dimension"))
        .select("dimension", value.alias("value"), "cnt")
        .where(F.col("value").isNotNull())
    )


def top_tags(docs: DataFrame, tags: str, limit: int = K.TAG_LIST_SIZE) -> DataFrame:
    """Most frequent members of an array column; null and empty arrays add nothing."""
    return (
        docs.select(F.explode(tags).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc("tag"))
        .limit(limit)
    )


def partial_counts(docs: DataFrame) -> DataFrame:
    """``(dimension, value, cnt)`` of one batch; such counts add up over batches.

    ``docs``: doc_type, direction, topics (array, nulls and repeats count as they stand) and n_chunks.
    One scan: every row gives its few values, which combine before the shuffle.
    """
    entry = lambda dimension, value, n: F.struct(F.lit(dimension).alias("dimension"), value.cast("string").alias("value"), n.cast("long").alias("n"))
    one, none = F.lit(1), F.lit(None)
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: entry("topic", t, one))
    fixed = F.array(
        entry("documents", none, one), entry("chunks", none, F.coalesce("n_chunks", F.lit(0))),
        entry("doc_type", F.col("doc_type"), one), entry("direction", F.col("direction"), one),
    )
    rows = docs.select(F.inline(F.concat(fixed, topics)))
    return rows.where("value IS NOT NULL OR dimension IN ('documents', 'chunks')").groupBy("dimension", "value").agg(F.sum("n").alias("cnt"))


def merged(counts: DataFrame, tags: int = K.TAG_LIST_SIZE) -> DataFrame:
    """Counts of many batches added up; of the topics only the ``tags`` most frequent, ties by name."""
    total = counts.groupBy("dimension", "value").agg(F.sum("cnt").alias("cnt"))
    top = total.where("dimension = 'topic'").orderBy(F.desc("cnt"), F.asc("value")).limit(tags)
    return total.where("dimension <> 'topic'").unionByName(top)


def optional_filter(
    docs: DataFrame,
    *,
    doc_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    type_column: str = "doc_type",
    date_column: str = "issued_on",
) -> DataFrame:
    """Conjunction of the parameters given; absent ones drop out, null dates fail range tests."""
    conditions: list[Column] = []
    if doc_type:
        conditions.append(F.col(type_column) == doc_type)
    if date_from:
        conditions.append(F.col(date_column) >= F.lit(date_from).cast("date"))
    if date_to:
        conditions.append(F.col(date_column) <= F.lit(date_to).cast("date"))
    for condition in conditions:
        docs = docs.where(condition)
    return docs


def matching(docs: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column holds the term, case ignored; ``%`` and ``_`` stay wildcards."""
    if not term:
        return docs
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.col(c).ilike(f"%{term}%")
    return docs.where(condition)


def newest(
    docs: DataFrame, date_column: str, id_column: str, limit: int | None = K.LISTING_SIZE
) -> DataFrame:
    """Newest first, undated last, ties by id; ``limit=None`` lists everything."""
    ordered = docs.orderBy(F.desc_nulls_last(date_column), F.asc(id_column))
    return ordered if limit is None else ordered.limit(limit)
