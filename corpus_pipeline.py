"""Corpus preparation in five stages over ``documents``: language, near copies, repeats, mix, packing.

Each stage works on all that the one before kept, takes effect on the rows, and is written as
Parquet in the shared folder before the next one reads it. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import chunk_dedup, language_id, mixing, near_dedup, packing
from dossier.llm.common import settle
from dossier.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or without a known language."""
    return language_id.keep_identified(docs, language_id.learn_profiles(language_id.learning_rows(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return near_dedup.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that repeat out of all but their first text; every row stays."""
    return chunk_dedup.strip_repeats(docs, "_llm_runs").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes blocks of each source up to its target; a document comes once for each pass that took some."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences of all rows."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("chunk_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Hash-based stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
