"""Document, chunk, history and hash tables as parquet below one folder.

Every write replaces the whole folder of its batch, so a replayed batch leaves the rows of its last
run and nothing of an earlier one. Content hashes have a table of their own, partitioned by a part
of the hash: the duplicate test of a batch reads the parts that the batch holds, and no documents.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators.stats import newest

DOCUMENT_SCHEMA = (
    "doc_id string, doc_no string, issued_on date, doc_type string, type_code string,"
    " policies array<string>, fields array<string>, topics array<string>, direction string,"
    " issuer string, signer string, signer_title string, subject string, role string,"
    " file_name string, file_path string, full_text string, source_url string, sha256 string,"
    " extract_method string, n_chunks int, ingested_at timestamp, raw_meta string"
)
CHUNK_SCHEMA = "chunk_id string, doc_id string, pos int, text string"
HISTORY_SCHEMA = "doc_no string"
HASH_SCHEMA, HASH_PARTS = "sha256 string", 64
COUNT_SCHEMA = "dimension string, value string, cnt long"
READ_COLUMNS = ("doc_id", "doc_no", "issued_on", "doc_type", "issuer", "subject", "full_text")


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _read(spark: SparkSession, path: str, schema: str, partitions: str) -> DataFrame:
    full = f"{schema}, {partitions}"
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def _write(df: DataFrame, path: str, batch_id: str, partitions: Sequence[str] = ()) -> None:
    """The rows of one batch, in a folder of its own that is replaced as a whole."""
    if not re.fullmatch(r"[\w.\-]+", batch_id, re.ASCII):
        raise ValueError(f"a batch id holds letters, digits, '_', '-' and '.': {batch_id!r}")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{path}/batch_id={batch_id}")


def hash_part(sha256: Column | str) -> Column:
    return F.pmod(F.xxhash64(sha256), F.lit(HASH_PARTS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def documents(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/documents", DOCUMENT_SCHEMA, "batch_id string")

    def chunks(self) -> DataFrame:
        return _read(
            self.spark, f"{self.folder}/chunks", CHUNK_SCHEMA, "batch_id string, direction string"
        )

    def history(self) -> DataFrame:
        return _read(
            self.spark, f"{self.folder}/history", HISTORY_SCHEMA, "batch_id string, direction string"
        )

    def counts(self) -> DataFrame:
        """Counts of every batch, see ``operators.stats.partial_counts``; they add up."""
        return _read(self.spark, f"{self.folder}/counts", COUNT_SCHEMA, "batch_id string")

    def hashes(self, parts: Sequence[int] | None = None) -> DataFrame:
        """Hashes of the stored contents; ``parts`` (of ``hash_part``) prunes the partitions read."""
        rows = _read(self.spark, f"{self.folder}/hashes", HASH_SCHEMA, "batch_id string, part int")
        return rows if parts is None else rows.where(F.col("part").isin(*parts))

    def stored_hashes(self, batch: DataFrame, without: str | None = None) -> DataFrame:
        """Stored hashes in the parts that ``batch(sha256)`` holds, without those of one batch id.

        At most ``HASH_PARTS`` numbers reach the driver.
        """
        parts = sorted(r["part"] for r in batch.select(hash_part("sha256").alias("part")).distinct().collect())
        rows = self.hashes(parts)
        return (rows if without is None else rows.where(F.col("batch_id") != without)).select("sha256")

    def write_documents(self, docs: DataFrame, batch_id: str) -> None:
        _write(docs.select(*_names(DOCUMENT_SCHEMA)), f"{self.folder}/documents", batch_id)
        hashes = docs.select("sha256").distinct().withColumn("part", hash_part("sha256"))
        _write(hashes.repartition("part"), f"{self.folder}/hashes", batch_id, ["part"])

    def write_chunks(self, chunks: DataFrame, batch_id: str) -> None:
        _write(chunks.select(*_names(CHUNK_SCHEMA), "direction"), f"{self.folder}/chunks", batch_id, ["direction"])

    def write_history(self, docs: DataFrame, batch_id: str) -> None:
        rows = docs.where(F.coalesce("doc_no", F.lit("")) != "").select("doc_no", "direction").distinct()
        _write(rows, f"{self.folder}/history", batch_id, ["direction"])

    def write_counts(self, counts: DataFrame, batch_id: str) -> None:
        _write(counts.select(*_names(COUNT_SCHEMA)), f"{self.folder}/counts", batch_id)


def read_documents(
    docs: DataFrame, where=None, limit: int | None = K.READ_LIMIT, columns: Sequence[str] = READ_COLUMNS,
    date_column: str = "issued_on", id_column: str = "doc_id",
) -> DataFrame:
    """Projection, optional condition, newest first, at most ``limit`` rows."""
    rows = docs.where(where) if where is not None else docs
    return newest(rows.select(*columns), date_column, id_column, limit)
