"""Choice of attachments and the fetch plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import file_kind, twin_key

# Columns of an attachment: doc_no, direction, path, name (lower case), ext, size.


def _holds_any(name: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | name.contains(mark)
    return found


def with_rules(files: DataFrame) -> DataFrame:
    """``kind`` of each attachment and ``valid``: whether the PDF rules of its direction admit it."""
    name = F.col("name")
    number = F.regexp_extract(F.coalesce("doc_no", F.lit("")), "[0-9]+", 0)
    signed = name.contains(K.SIGNED_MARK)
    outgoing_ok = ~_holds_any(name, K.OUTGOING_EXCLUDED) & (
        signed | (number == "") | name.contains(number)
    )
    incoming_ok = ~_holds_any(name, K.INCOMING_EXCLUDED)
    is_out = F.col("direction") == K.OUTGOING
    kind = file_kind("ext")
    return files.withColumn("kind", kind).withColumn(
        "valid",
        F.when(kind == "pdf", F.when(is_out, outgoing_ok).otherwise(incoming_ok))
        .otherwise(kind != "other"),
    ).withColumn("signed", signed)


def group_sizes(files: DataFrame) -> DataFrame:
    """Attachments per (number, direction)."""
    return files.groupBy("doc_no", "direction").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size")
    )


def main_outgoing(ruled: DataFrame) -> DataFrame:
    """One main file per outgoing document: signed PDF, else valid PDF, else Word; the largest.

    The per-group cut runs in each task before the exchange, so a group of any size is safe.
    """
    tier = (
        F.when((F.col("kind") == "pdf") & F.col("signed"), 1)
        .when(F.col("kind") == "pdf", 2)
        .when(F.col("kind") == "word", 3)
    )
    order = Window.partitionBy("doc_no").orderBy("tier", F.desc("size"), "path")
    return (
        ruled.where((F.col("direction") == K.OUTGOING) & F.col("valid"))
        .withColumn("tier", tier)
        .where(F.col("tier").isNotNull())
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") == 1)
        .drop("_rn", "tier")
    )


def without_twin(ruled: DataFrame) -> DataFrame:
    """Incoming Word files whose name is not that of an admitted PDF of the same document."""
    incoming = ruled.where((F.col("direction") != K.OUTGOING) & F.col("valid")).withColumn(
        "base_name", twin_key("name")
    )
    keys = ["doc_no", "direction", "base_name"]
    pdfs = incoming.where(F.col("kind") == "pdf").select(*keys)
    return incoming.where(F.col("kind") == "word").join(pdfs, keys, "left_anti").drop("base_name")


def select_attachments(files: DataFrame) -> DataFrame:
    """Attachments to keep, each with the reason, in one pass over the files; nothing is deleted.

    Outgoing: the main file of each number. Incoming: admitted PDFs, and Word files without a PDF
    twin. Sheets always. Rank and twin come from windows that share one exchange by number.
    """
    ruled = with_rules(files)
    is_out, kind = F.col("direction") == K.OUTGOING, F.col("kind")
    tier = F.when(is_out & F.col("valid"), F.when(kind == "pdf", F.when(F.col("signed"), 1).otherwise(2)).when(kind == "word", 3))
    order = Window.partitionBy("doc_no", is_out).orderBy(F.asc_nulls_last("_tier"), F.desc("size"), "path")
    twins = Window.partitionBy("doc_no", is_out, "direction", "_base")
    marked = ruled.withColumns({"_tier": tier, "_base": twin_key("name")}).repartition("doc_no").withColumns({
        "_rn": F.row_number().over(order),
        "_twin": F.max(~is_out & (kind == "pdf") & F.col("valid")).over(twins),
    })
    reason = (
        F.when(F.col("_tier").isNotNull() & (F.col("_rn") == 1), "main file")
        .when(kind == "sheet", "sheet")
        .when(~is_out & F.col("valid") & (kind == "pdf"), "incoming pdf")
        .when(~is_out & F.col("valid") & (kind == "word") & ~F.col("_twin"), "word without pdf twin")
    )
    return marked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*files.columns, "kind", "reason")


def unseen(listing: DataFrame, history: DataFrame) -> DataFrame:
    """Listing rows with a number that the history of their direction does not hold."""
    keys = ["direction", "doc_no"]
    known = history.select(*keys)
    return listing.where(F.coalesce("doc_no", F.lit("")) != "").join(known, keys, "left_anti")


def fetch_budget(listing: DataFrame, history: DataFrame, limit: int = 0) -> DataFrame:
    """New rows, one per number, outgoing first and newest first; the first ``limit`` (0 = all)."""
    order = Window.partitionBy("direction", "doc_no").orderBy(
        F.desc_nulls_last("issued_on"), *[F.asc(c) for c in sorted(listing.columns) if c not in ("direction", "doc_no", "issued_on")]
    )
    once = (
        unseen(listing, history)
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )
    first = F.when(F.col("direction") == K.OUTGOING, 0).otherwise(1)
    ordered = once.orderBy(first, F.desc_nulls_last("issued_on"), F.asc("doc_no"))
    return ordered.limit(limit) if limit > 0 else ordered
