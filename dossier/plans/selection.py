"""What to fetch next, and which of the fetched files to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import safe_name
from dossier.operators.selection import fetch_budget, select_attachments
from dossier.sources.files import attachments, read_files, read_sidecars


def select_from_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Attachments kept from a download folder, and the sidecars that could not be read."""
    sidecars, rejects = read_sidecars(spark, folder)
    return select_attachments(attachments(sidecars, read_files(spark, folder))), rejects


def fetch_plan(listing: DataFrame, history: DataFrame, limit: int = 0) -> DataFrame:
    """Rows to fetch, each with the prefix its files will carry."""
    return fetch_budget(listing, history, limit).withColumn(
        "file_prefix", F.concat(safe_name("doc_no"), F.lit("_"))
    )
