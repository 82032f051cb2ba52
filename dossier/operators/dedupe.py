"""First row per content and rows not stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_content(rows: DataFrame, order_by: str, hash_column: str = "sha256") -> DataFrame:
    """One row per hash, the first by ``order_by``.

    Spark keeps one row per hash in each task before it shuffles, so a group of copies that holds
    a large share of the table sends one row per task.
    """
    order = Window.partitionBy(hash_column).orderBy(F.asc(order_by))
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def not_stored(rows: DataFrame, stored: DataFrame, hash_column: str = "sha256") -> DataFrame:
    return rows.join(stored.select(hash_column), hash_column, "left_anti")


def insert_status(
    batch: DataFrame, stored: DataFrame, order_by: str, hash_column: str = "sha256"
) -> DataFrame:
    """Every row of the batch with ``status``: ``inserted`` or ``duplicate``.

    Works on hash, order key and place of the row; a text is never sorted or shuffled here. Of rows
    equal in hash and order key one is inserted, the first in the order of the table's partitions.
    """
    placed = batch.withColumn("_place", F.monotonically_increasing_id())
    first = placed.groupBy(hash_column).agg(F.min(F.struct(order_by, "_place"))["_place"].alias("_first"))
    new = not_stored(first, stored, hash_column).select(F.col(hash_column).alias("_hash"), "_first")
    same = (placed[hash_column] == new["_hash"]) & (placed["_place"] == new["_first"])
    return (
        placed.join(new, same, "left")
        .withColumn("status", F.when(F.col("_first").isNotNull(), "inserted").otherwise("duplicate"))
        .drop("_hash", "_first", "_place")
    )
