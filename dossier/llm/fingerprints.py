"""Document fingerprints by Order MinHash over character k-mers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import shingles, shuffle_width, slices
from dossier.llm.omh import sketch

KMER, SIZE, TUPLE = 6, 48, 2
_LOWEST = -(1 << 63)


def signature(text: str, kmer: int = KMER, size: int = SIZE, tuple_size: int = TUPLE) -> np.ndarray:
    """32-bit components of the whole text's sketch. Equal texts have equal ones; '' gives zeros."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (sketch(shingles(points, kmer), size, tuple_size) >> np.uint64(32)).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of components that agree; an estimate that falls with edit distance."""
    return float(np.mean(a == b))


def edited(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as many opening characters of ``other`` (or all)."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``docs[id_col], n_chars, fingerprint``: one row for each row, in one pass without a shuffle.

    Null text counts as empty; an empty text's fingerprint is all zeros; null ids stay null.
    """

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([signature(t, **sizes).tobytes().hex() for t in texts], pa.string()),
                ],
                names=[id_col, "n_chars", "fingerprint"],
            )

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_chars long, fingerprint string")


def _ranges(keys: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` cut points that deal the keys into ranges of about equal size."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = keys.agg(F.percentile_approx("key", shares, F.lit(10_000)).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def _range_of(key: str, cuts: list[int]):
    """Index of the key's range, found in two short lists instead of one long one."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(key)))
    coarse = F.greatest(below(F.array(*[F.lit(g[0]) for g in groups])) - 1, F.lit(0))
    return (coarse * step + below(F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), coarse))).cast("int")


def with_successors(docs: DataFrame) -> DataFrame:
    """Deal the rows into descending ranges of ``doc_id`` so that each row's successor follows it.

    The text is shuffled once. The first row of each range is also sent to the end of the range
    before it (of the last, for the first of all), marked ``tail``. Rows are ordered by id
    descending, then by a hash of the text; null ids come last.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"key": F.coalesce("doc_id", F.lit(_LOWEST)), "tie": F.xxhash64("text")})
    parts = shuffle_width(docs)
    cuts = _ranges(rows.select("key"), parts)
    rows = rows.withColumn("part", _range_of("key", cuts))
    heads = {r["part"]: (r["head"]["key"], r["head"]["tie"]) for r in rows.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first of all goes to the last range
    pick = lambda values, kind: F.get(F.array(*[F.lit(values.get(p)).cast(kind) for p in range(len(cuts) + 1)]), F.col("part"))
    is_head = (F.col("key") == pick({p: h[0] for p, h in heads.items()}, "long")) & (F.col("tie") == pick({p: h[1] for p, h in heads.items()}, "long"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    copy = F.struct(pick(before, "int").alias("part"), F.lit(True).alias("tail"))
    return (
        rows.withColumn("place", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))))
        .select("doc_id", "text", "key", "tie", "place.part", "place.tail")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "tail", F.desc("key"), F.desc("tie"))
    )


def compare_with_edits(docs: DataFrame, **sizes: int) -> DataFrame:
    """Fingerprint every document, its edited text and its successor, and tell how alike they are.

    Null text is empty. A lone document is its own successor. Repeated rows each give a row.
    """

    def run(batches):
        held = None  # (part, id, text, signature) that waits for its successor
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text, part, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] != part:
                    held = None
                if tail and held is None:
                    continue
                own = signature(text, **sizes)
                if held:
                    changed = edited(held[2], text)
                    new = signature(changed, **sizes)
                    out.append((
                        held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), held[3].tobytes().hex(),
                        new.tobytes().hex(), likeness(held[3], new), likeness(held[3], own),
                    ))
                held = None if tail else (part, doc_id, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names,
            )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs).select("doc_id", "text", "part", "tail").mapInArrow(run, schema)
