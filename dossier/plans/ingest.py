"""Ingest of a batch: choose text, drop what is stored, normalise metadata, chunk, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.replies import parse_reply
from dossier.functions.text import content_hash, strip, strip_nul
from dossier.operators.assembly import choose_text, split_rejects
from dossier.operators.chunking import chunk_table, structural_chunks
from dossier.operators.dedupe import not_stored
from dossier.operators.metadata import REPLY_SCHEMA, doc_types, normalise
from dossier.operators.stats import partial_counts
from dossier.session import cut_lineage
from dossier.sources.store import Store

SIDE_COLUMNS = ("doc_no", "issued_on", "subject", "issuer")
# A batch carries ``path`` and either ``text``, taken as it is, or ``native_text`` and ``ocr_text``,
# between which the choice is made here. All other columns are optional.
OPTIONAL = (
    "native_text", "ocr_text", "extract_method", "reply", "direction", "sha256", "source_url", "raw_meta",
    *(f"side_{c}" for c in SIDE_COLUMNS),
)


def completed(batch: DataFrame) -> DataFrame:
    """Missing optional columns added as nulls; the hash taken from the text where none came."""
    parts = ["text"] if "text" in batch.columns else ["native_text", "ocr_text"]
    for name in OPTIONAL:
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(None).cast("string"))
    return batch.withColumns(
        {
            "direction": F.coalesce("direction", F.lit(K.OUTGOING)),
            "sha256": F.coalesce("sha256", content_hash(F.concat_ws("", *parts))),
        }
    )


def _texts(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with text and rows without."""
    if "text" in batch.columns:
        return split_rejects(batch.withColumn("text", strip("text")))
    return split_rejects(choose_text(batch))


def fresh_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """First row per content that the store does not hold; done before any costly step.

    The choice is made on (hash, path, digest of the row) alone, so it is the same in every run; only
    the rows that stay are matched with their texts. Rows equal in all columns are one.
    """
    marked = batch.withColumn("_mark", F.xxhash64(*[c for c in OPTIONAL if c in batch.columns]))
    first = marked.groupBy("sha256").agg(F.min(F.struct("path", "_mark")).alias("_first")).select("sha256", "_first.*")
    found = marked.join(not_stored(first, stored), ["sha256", "path", "_mark"], "left_semi")
    return found.dropDuplicates(["sha256"]).drop("_mark")


def to_documents(
    rows: DataFrame, types: DataFrame, ingested_at: Column,
    size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
    separators: Sequence[str] = K.SEPARATORS,
) -> DataFrame:
    """Rows of the document table, with the chunks of each text in ``_chunks``."""
    with_text, _ = _texts(rows)
    clean = with_text.withColumn("full_text", strip_nul("text"))
    replied = clean.withColumn("_r", parse_reply("reply", REPLY_SCHEMA)).select("*", "_r.*").drop("_r")
    normal = normalise(replied, types)
    name = F.regexp_extract("path", "([^/]*)\\z", 1)
    chunked = normal.withColumn("_chunks", structural_chunks("full_text", size, overlap, separators))
    return chunked.withColumns(
        {
            "doc_id": F.col("sha256"),
            "file_name": name,
            "file_path": F.col("path"),
            "n_chunks": F.size("_chunks"),
            "ingested_at": ingested_at,
        }
    )


def ingest(
    batch: DataFrame, store: Store, batch_id: str, ingested_at: Column | None = None
) -> DataFrame:
    """Writes documents, chunks, history and counts of one batch and returns the documents written.

    Replaying a batch id replaces its own partitions and sees the store without them.
    """
    spark = batch.sparkSession
    batch = completed(batch)
    rows = fresh_rows(batch, store.stored_hashes(batch, without=batch_id))
    stamp = ingested_at if ingested_at is not None else F.current_timestamp()
    # Cutting the text is the costly step; all tables start from these checkpointed rows.
    prepared = cut_lineage(to_documents(rows, doc_types(spark), stamp))
    store.write_documents(prepared, batch_id)
    store.write_chunks(chunk_table(prepared, F.col("_chunks"), keep=["direction"]), batch_id)
    store.write_history(prepared, batch_id)
    store.write_counts(partial_counts(prepared), batch_id)
    return store.documents().where(F.col("batch_id") == batch_id)


def rejected(batch: DataFrame) -> DataFrame:
    """Rows of a batch with no text from either source."""
    return _texts(completed(batch))[1].select("path", "extract_method")
