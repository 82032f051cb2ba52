"""The given tables in the shapes that the operators take, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.chunking import chunk_table, fixed_chunks
from dossier.session import fill_cores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for costly row work, on all cores even when it is a single row group."""
    return fill_cores(table(spark, sf_dir, name), key)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk with its payload; vector, label and date are null where it has no vector."""
    docs = spread(spark, sf_dir, "documents", "doc_id")
    vectors = table(spark, sf_dir, "embeddings")
    ids = vectors.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1").isEmpty():
        # Changes no row, but tells the planner that the join adds none: where no vector is asked for, texts are not shuffled to meet it.
        vectors = vectors.dropDuplicates(["vec_id"])
    return docs.join(vectors, docs.doc_id == vectors.vec_id, "left").select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        "embedding",
        F.col("source").alias("doc_type"),
        F.col("lang").alias("direction"),
        F.concat_ws("/", F.col("doc_id").cast("string"), "source").alias("doc_no"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("label")).alias("issued_on"),
    )


CORPUS = """corpus AS (
  SELECT d.doc_id AS chunk_id, d.text, e.embedding, d.source AS doc_type, d.lang AS direction,
         d.doc_id || '/' || d.source AS doc_no, DATE '2024-01-01' + e.label AS issued_on
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with its vector; half of them ask for one direction only."""
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings")
    return items.join(vectors, items.item_id == vectors.vec_id, "left").select(
        F.col("item_id").alias("query_id"),
        "text",
        "embedding",
        F.lit(None).cast("string").alias("doc_type"),
        F.when(F.col("label") < 5, "en").alias("direction"),
    )


QUERIES_CTE = """queries AS (
  SELECT b.item_id AS query_id, b.text, e.embedding, CAST(NULL AS VARCHAR) AS doc_type,
         CASE WHEN e.label < 5 THEN 'en' END AS direction
  FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id)"""


def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents", "doc_id")
    return chunk_table(docs, fixed_chunks("text"))


WINDOW_CHUNKS = """window_chunks AS (
  SELECT sha256(doc_id || '‖' || pos) AS chunk_id, doc_id, pos, text FROM (
    SELECT doc_id, CAST(0 AS INTEGER) AS pos, text FROM documents
    WHERE length(text) <= 1000 AND regexp_matches(text, '[^\\s]')
    UNION ALL
    SELECT doc_id, CAST(i AS INTEGER), substr(text, CAST(i * 800 + 1 AS BIGINT), 1000)
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i
          FROM documents WHERE length(text) > 1000)))"""
