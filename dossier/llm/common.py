"""Helpers of the text-preparation operators: written steps, row batches, hashing, word runs."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.session import scratch_path

# Splitmix64 finaliser (fixed values).
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


# Rows of text that a Python worker gets at once, and that it turns into Python objects at once.
TEXT_ROWS, SLICE_ROWS = "256", 256


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, a lost executor costs nothing.

    Unlike a checkpoint the table is columnar, compressed and of known size, so later joins are
    planned on what it really holds. While it is written, row batches to Python workers are kept
    small, because one row may hold a very long text.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch_path(spark, name), spark.conf.get(key)
    spark.conf.set(key, TEXT_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit values."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers; sizes are rounded up so that few tables are kept."""
    return _powers(1 << max(12, int(n - 1).bit_length()))


@functools.cache
def _word_bytes() -> np.ndarray:
    """Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    table[128:] = True
    for lo, hi in ("09", "az", "AZ"):
        table[ord(lo) : ord(hi) + 1] = True
    return table


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the lower-cased text.

    Words are runs of ASCII letters and digits and of non-ASCII characters; everything else parts
    them. Null and a text without words give an empty array.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _word_bytes()[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbours; a shorter sequence gives one run, an empty one none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _M2 + words[i : i + n]
    return mix(out)
