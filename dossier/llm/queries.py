"""Registered queries of the text-preparation operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import (
    alignment,
    chunk_dedup,
    collocations,
    embedding_dedup,
    fingerprints,
    language_id,
    licenses,
    line_rules,
    mixing,
    near_dedup,
    oracles,
    packing,
    quality,
    url_filters,
)
from dossier.llm.common import remainder

URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def q_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunk_dedup.strip_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return docs.select(
        "doc_id", "text", F.col("n_chars").alias("kept_chars"), F.size("runs").alias("n_removed"),
        F.array_sort(F.array_distinct(F.transform("runs", lambda r: r["first_doc_id"]))).alias("first_doc_ids"), "runs",
    )


def q_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, rule string")
    return url_filters.judge_urls(pages, rules, url_filters.alias_edges(pages))


def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def q_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def q_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_classes(_table(spark, sf_dir, "embeddings"))


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(language_id.learning_rows(docs))
    rows = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return language_id.identify(rows, profiles, ["doc_id", "held_out"])


def q_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), *[c for c in rows.columns if c not in ("row", "clean_text")])


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def q_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path())


def q_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": q_near_dedup,
    "op2_url_filters": q_urls,
    "op3_fingerprints": q_fingerprints,
    "op4_quality": q_quality,
    "op5_licenses": q_licenses,
    "op6_packing": q_packing,
    "op7_chunk_dedup": q_chunk_dedup,
    "op8_mixing": q_mixing,
    "op9_embedding_dedup": q_embeddings,
    "op10_language": q_language,
    "op11_line_rules": q_line_rules,
    "op12_alignment": q_alignment,
    "op13_collocations": q_collocations,
}

ORACLE: dict[str, str] = {
    "op2_url_filters": oracles.url_filters(URL_RULES),
    "op5_licenses": oracles.license_scan(),
    "op11_line_rules": oracles.line_rules_sql(),
    "op13_collocations": oracles.collocations_sql(),
}
