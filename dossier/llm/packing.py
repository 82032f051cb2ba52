"""Best-fit packing of token sequences, bulk-synchronous.

Pieces are range-sorted by length, which gives every piece its rank among those of equal length.
The sweep then goes over the length classes from the longest to the shortest. In each round all
pieces of one class look for their successor among the open gaps (the smallest gap that holds
them), conflicts are resolved by rank (the first ranks fill the first gap), the gaps shrink and
the next round begins. Pieces of a class and gaps of a size are alike, so a round exchanges only
counts, at most one number per length; the rows themselves are matched by rank afterwards, in
parallel. The result is that of best-fit decreasing over all pieces.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import settle, shuffle_width, slices

LIMIT, END = 1024, 2
# Fixed value: how the byte-level tokenizer parts a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: printable bytes stand for themselves in the vocabulary, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
# White space on which regular-expression libraries disagree, and runs of it so long that those of the faster library
# overflow their stack: such texts take the plain way.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b]")
_RUN = re.compile(r"\s{10000}")


class _Encoder:
    """Token ids of a text as little-endian bytes.

    The merges of the tokenizer's file run in a faster library that gives the same ids; texts with
    characters or special tokens on which the two may differ go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(map(_BYTE_OF.__getitem__, token)): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("from-file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text) or _RUN.search(text) or any(s in text for s in self.special):
            return self.plain(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@functools.cache
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are full."""
    first = n % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def tokenise(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and the end id, cut to pieces.

    Null text counts as empty and gives a piece of the end id alone. ``path`` is the tokenizer's
    file, which every executor must be able to read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"))
    close = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(path)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + close
                out += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, limit))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over classes: ``(length, first rank, pieces per sequence, first sequence, offset)``.

    A row says where the pieces of this length go from that rank on, up to the next row's rank.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # free places -> (first sequence, how many)
    rows, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, many: int, gap: int, length: int = length) -> int:
            """Fill up to ``many`` sequences of this gap; how many were touched."""
            nonlocal left, rank
            each = gap // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            rows.append((length, rank, each, first, limit - gap))
            if full:
                gaps.setdefault(gap - each * length, []).append((first, full))
            if rest:
                gaps.setdefault(gap - rest * length, []).append((first + full, 1))
            left, rank = left - full * each - rest, rank + full * each + rest
            return full + bool(rest)

        for gap in sorted(g for g in gaps if g >= length):  # successors, nearest first
            runs = gaps.pop(gap)
            while runs and left:
                first, many = runs.pop()
                used = place(first, many, gap)
                if used < many:
                    runs.append((first + used, many - used))
            if runs:
                gaps.setdefault(gap, []).extend(runs)
            if not left:
                break
        if left:
            made += place(made, left, limit)
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) among the pieces of equal length; no order among equals is promised.

    The table is range-sorted by length and a hash, so a frequent length spreads over many ranges.
    Ranks inside a range come from a window, those before it from the ranges' counts.
    """
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranges = settle(
        pieces.withColumn("_spread", spread).repartitionByRange(shuffle_width(pieces), F.desc("length"), "_spread")
        .withColumn("_range", F.spark_partition_id()), "ranges",
    )
    over = Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("length", "_range").agg(F.count("*").alias("n")).select("length", "_range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_range").orderBy("_spread", "doc_id", "piece")
    return (
        ranges.withColumn("_nth", F.row_number().over(inside)).join(before, ["length", "_range"])
        .withColumn("rank", F.col("_base") + F.col("_nth") - 1).select(*pieces.columns, "rank")
    )


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``limit``; places are gapless from 0.

    The driver holds one count per length and the rounds' rows, both bounded by ``limit``.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rounds = sorted(sweep(counts, limit))
    keys = np.array([(r[0] << 44) + r[1] for r in rounds], np.int64)
    first_rank, each, first, offset = (np.array([r[i] for r in rounds], np.int64) for i in (1, 2, 3, 4))
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches):
        for batch in slices(batches):
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            nth = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(first[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * length)], names=names,
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked(pieces).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row."""
    return pack(settle(tokenise(docs, path, limit, end), "pieces"), limit)
