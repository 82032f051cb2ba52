"""Download folder: sidecar records and the attachments they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import file_extension

SIDECAR_SUFFIX = ".meta.json"

# Keys of a sidecar record and our column for each.
SIDECAR_KEYS = (
    ("so_ky_hieu", "doc_no"),
    ("ngay_ban_hanh", "issued_on"),
    ("trich_yeu", "subject"),
    ("huong", "direction"),
    ("co_quan_ban_hanh", "issuer"),
    ("file_goc", "original_name"),
)


def _plain_path(path: Column) -> Column:
    """One spelling for a path, whether or not the source encodes it."""
    decoded = F.when(
        path.contains("%"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    ).otherwise(path)
    return F.regexp_replace(F.coalesce(decoded, path), "^file:/+", "/")


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)\\z", 1)


def direction_of(code: Column) -> Column:
    """``out`` / ``in`` from a sidecar code; unknown codes follow the incoming rules."""
    outgoing = F.coalesce(code, F.lit("di")) == "di"
    return F.when(outgoing, K.OUTGOING).otherwise(K.INCOMING)


def read_sidecars(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readable records and the paths of unreadable ones.

    A missing number becomes ``unknown_<sidecar file>``, a missing direction outgoing.
    """
    schema = ", ".join(f"{key} string" for key, _ in SIDECAR_KEYS) + ", _corrupt string"
    raw = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{SIDECAR_SUFFIX}")
        .json(folder)
        .select("*", _plain_path(F.col("_metadata.file_path")).alias("sidecar_path"))
    )
    renamed = raw.select(
        *[F.col(key).alias(name) for key, name in SIDECAR_KEYS], "sidecar_path", "_corrupt"
    )
    records = (
        renamed.where(F.col("_corrupt").isNull())
        .drop("_corrupt")
        .withColumn("doc_no", F.coalesce("doc_no", F.concat(F.lit("unknown_"), _base_name(F.col("sidecar_path")))))
        .withColumn("direction", direction_of(F.col("direction")))
        .withColumn("path", F.regexp_replace("sidecar_path", "\\.meta\\.json\\z", ""))
    )
    # Spark refuses to scan JSON for the corrupt text alone, hence the second column.
    bad = F.col("_corrupt").isNotNull() & F.coalesce("doc_no", "_corrupt").isNotNull()
    rejects = renamed.where(bad).select("sidecar_path")
    return records, rejects


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, ext, size)`` of the attachments; the content column is never read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(_plain_path(F.col("path")).alias("path"), F.col("length").alias("size"))
    )
    name = _base_name(F.col("path"))
    return listed.where(~F.col("path").endswith(SIDECAR_SUFFIX)).select(
        "path", F.lower(name).alias("name"), file_extension(name).alias("ext"), "size"
    )


def attachments(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecar beside its file; a sidecar without file is dropped."""
    return sidecars.drop("sidecar_path").join(files, "path")
