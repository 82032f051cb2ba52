"""Cutting document text into overlapping chunks, one row in and one array out, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import bound, is_blank, tail


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")


def _windows(text: Column, size: int, overlap: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def fixed_chunks(
    text: Column | str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> Column:
    """Windows of ``size`` code points every ``size - overlap``; a short text is one chunk."""
    _check(size, overlap)
    text = F.col(text) if isinstance(text, str) else text
    return (
        F.when(text.isNull() | is_blank(text), F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(text))
        .otherwise(_windows(text, size, overlap))
    )


def _structural(text: Column, seps: Sequence[str], size: int, overlap: int) -> Column:
    if not seps:
        cut = _windows(text, size, overlap)
    else:
        cut = _packed(text, seps[0], seps[1:], size, overlap)
    chunks = F.when(F.length(text) <= size, F.array(text)).otherwise(cut)
    return F.filter(chunks, lambda c: ~is_blank(c))


def _packed(text: Column, sep: str, finer: Sequence[str], size: int, overlap: int) -> Column:
    """Pieces packed greedily up to ``size``.

    Every piece but the first starts with its separator, so no character is lost. A text without
    the separator is one over-long piece and falls through to the finer separators.
    """
    pieces = F.transform(
        F.split(text, f"\\Q{sep}\\E", -1),
        lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p)),
    )
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def state(out: Column, buf: Column) -> Column:
        return F.struct(out.alias("out"), buf.alias("buf"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["buf"] == "", acc["out"]).otherwise(
            F.concat(acc["out"], F.array(acc["buf"]))
        )

    def overflow(out: Column, piece: Column) -> Column:
        led = F.when(
            F.size(out) > 0, F.concat(tail(F.element_at(out, -1), overlap), piece)
        ).otherwise(piece)
        return bound(
            led,
            lambda t: F.when(F.length(t) <= size, state(out, t)).otherwise(
                state(F.concat(out, _structural(t, finer, size, overlap)), F.lit(""))
            ),
        )

    def step(acc: Column, piece: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(piece) <= size
        return F.when(fits, state(acc["out"], F.concat(acc["buf"], piece))).otherwise(
            bound(flushed(acc), lambda out: overflow(out, piece))
        )

    return F.aggregate(pieces, empty, step, flushed)


def structural_chunks(
    text: Column | str,
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
    separators: Sequence[str] = K.SEPARATORS,
) -> Column:
    """Chunks along the coarsest separator present, over-long pieces cut by the finer ones.

    A flushed chunk's last ``overlap`` characters open the next one; after a piece that had to be
    cut further the next chunk starts without overlap; blank chunks are dropped.
    """
    _check(size, overlap)
    text = F.col(text) if isinstance(text, str) else text
    return _structural(text, tuple(separators), size, overlap)


def chunk_table(
    docs: DataFrame, chunks: Column, doc_id: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per chunk: id from document and position, so a rerun writes the same ids."""
    rows = docs.select(doc_id, *keep, F.posexplode(chunks).alias("pos", "text"))
    chunk_id = F.sha2(
        F.concat_ws("‖", F.col(doc_id).cast("string"), F.col("pos").cast("string")), 256
    )
    return rows.select(chunk_id.alias("chunk_id"), doc_id, "pos", *keep, "text")


def chunk_counts(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return chunks.groupBy(doc_id).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))


def with_payload(chunks: DataFrame, docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Document columns beside each chunk. A join, so that the payload is stored only once."""
    return chunks.join(docs.select("doc_id", *columns), "doc_id")


def integrity(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without chunks and chunks whose document is missing."""
    childless = docs.select("doc_id").join(chunks.select("doc_id"), "doc_id", "left_anti")
    orphans = chunks.select("doc_id", "chunk_id").join(docs.select("doc_id"), "doc_id", "left_anti")
    return childless.select(
        F.lit("document_without_chunks").alias("problem"),
        "doc_id",
        F.lit(None).cast("string").alias("chunk_id"),
    ).unionByName(orphans.select(F.lit("chunk_without_document").alias("problem"), "doc_id", "chunk_id"))
