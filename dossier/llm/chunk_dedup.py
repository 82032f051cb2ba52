"""Repeated passages by content-defined chunking with a gear rolling hash.

A text is cut where the hash of the 32 bytes before a word's end has two zero bits, and where these
bytes hold no white space, at any end of a character at which three bits are zero. So cuts depend on
content alone in any script, and an insertion moves only those next to it. Chunks with equal digests repeat;
the first occurrence by document and place stays. Runs of repeated chunks are grown, character by
character, as far as the text goes on as beside the first occurrence, and runs that then hold at
least ``min_words`` words are taken out of the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import mix, settle, slices

LEAST, MOST, MASK, REACH = 32, 256, 0b11 << 30, 256
# A passage that repeats: so many words, or so many bytes for each of them where white space is rare.
MIN_WORDS, WORD_BYTES = 40, 8
WINDOW, UNSPACED_MASK = 32, 0b111 << 29
_GEAR = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """32-bit gear hash after each byte: sum of gear[byte] << age over the last 32 bytes."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(raw: np.ndarray, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a UTF-8 text; each has ``least`` to ``most`` bytes (the last may have fewer).

    A cut comes after white space at which the hash fits, or between characters at which it fits
    its stricter mask if the ``WINDOW`` bytes before hold no white space; a chunk that finds none
    ends at ``most`` bytes, moved back to the start of a character.
    """
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    seen = np.cumsum(space)
    unspaced = seen == np.concatenate((np.zeros(min(WINDOW, len(raw)), seen.dtype), seen[:-WINDOW]))
    whole = np.append((raw[1:] & 0xC0) != 0x80, True)
    hashes = gear_hash(raw)
    fits = np.flatnonzero((space & ((hashes & np.uint32(MASK)) == 0)) | (unspaced & whole & ((hashes & np.uint32(UNSPACED_MASK)) == 0))) + 1
    out, last, n = [], 0, len(raw)
    for at in [*fits.tolist(), n]:
        while at - last > most:
            end = last + most
            while end > last + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(end)
            last = end
        if at - last >= least or at == n > last:
            out.append(at)
            last = at
    return out


def chunks(docs: DataFrame, **sizes: int) -> DataFrame:
    """``doc_id, version, hi, lo, start, size, last``: every chunk of every row.

    ``hi, lo`` are a 128-bit digest; ``start, size`` count characters; ``last`` marks the chunk
    that ends the text; ``version`` is a hash of the whole text, by which rows that repeat an id
    are told apart. Null and empty texts give none.
    """
    rows = docs.where("length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")

    def run(batches):
        for batch in slices(batches):
            ids, versions, hi, lo, start, size, final = [], [], [], [], [], [], []
            for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                raw = np.frombuffer(data, np.uint8)
                ends = cuts(raw, **sizes)
                points = np.cumsum((raw & 0xC0) != 0x80)[np.array(ends) - 1].tolist()
                last = at = 0
                for end, point in zip(ends, points, strict=True):
                    digest = xxhash.xxh3_128_intdigest(data[last:end])
                    hi.append((digest >> 64) - (1 << 63))
                    lo.append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    start.append(at)
                    size.append(point - at)
                    last, at = end, point
                ids += [doc_id] * len(ends)
                versions += [version] * len(ends)
                final += [False] * (len(ends) - 1) + [True]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip((ids, versions, hi, lo, start, size, final), kinds, strict=True)], names=names,
            )

    names = ["doc_id", "version", "hi", "lo", "start", "size", "last"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
    return rows.mapInArrow(run, "doc_id long, version long, hi long, lo long, start int, size int, last boolean")


def _key() -> Column:
    """The id by which first occurrences are ordered: null ids come after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def repeated_runs(docs: DataFrame, **sizes: int) -> DataFrame:
    """``doc_id, version, start, size, chunks, last, head, tail``: every run of repeated chunks, before it is grown.

    ``head`` (id, version, at) is the place in the first occurrence at which the run's first chunk
    begins, ``tail`` that at which its last chunk ends. First occurrences are found by an aggregate
    that combines before the shuffle and are written, so joining a frequent chunk back to its
    occurrences can be split.
    """
    place = F.struct(_key().alias("id"), "version", "start")
    found = settle(chunks(docs, **sizes), "chunks")
    first = settle(found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "first"), "first")
    again = found.join(first, ["hi", "lo"]).where(place != F.col("first"))
    per_text = again.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("start", "size", "last", "first"))).alias("hits"))

    def merge(batches):
        for batch in slices(batches):
            out = []
            for hits in batch.column(2).to_pylist():
                runs = []
                for h in hits:
                    head = {"id": h["first"]["id"], "version": h["first"]["version"], "at": h["first"]["start"]}
                    tail = head | {"at": head["at"] + h["size"]}
                    if runs and runs[-1]["start"] + runs[-1]["size"] == h["start"]:
                        runs[-1].update(size=runs[-1]["size"] + h["size"], chunks=runs[-1]["chunks"] + 1, last=h["last"], tail=tail)
                    else:
                        runs.append({"start": h["start"], "size": h["size"], "chunks": 1, "last": h["last"], "head": head, "tail": tail})
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "version", "runs"])

    spot = pa.struct([("id", pa.int64()), ("version", pa.int64()), ("at", pa.int32())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("chunks", pa.int32()), ("last", pa.bool_()), ("head", spot), ("tail", spot)]))
    spots = "struct<id:bigint,version:bigint,at:int>"
    schema = f"doc_id long, version long, runs array<struct<start:int,size:int,chunks:int,last:boolean,head:{spots},tail:{spots}>>"
    return per_text.mapInArrow(merge, schema).select("doc_id", "version", F.inline("runs"))


def _surroundings(docs: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    """``id, version, at, side, near``: up to ``reach`` characters before (side 0) or after (side 1) each place."""
    wanted = places.groupBy("id", "version").agg(F.collect_set(F.struct("at", "side")).alias("wanted"))
    rows = docs.where("length(text) > 0").select(_key().alias("id"), F.xxhash64("text").alias("version"), "text").join(wanted, ["id", "version"])

    def run(batches):
        for batch in slices(batches):
            out = [[], [], [], [], []]
            for id_, version, text, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in spots:
                    at = s["at"]
                    near = text[at : at + reach] if s["side"] else text[max(0, at - reach) : at]
                    for column, value in zip(out, (id_, version, at, s["side"], near), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["id", "version", "at", "side", "near"])

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    found = rows.mapInArrow(run, "id long, version long, at int, side int, near string")
    # Equal rows of one id bring equal surroundings.
    return found.groupBy("id", "version", "at", "side").agg(F.min("near").alias("near"))


def _edged_runs(docs: DataFrame, reach: int, **sizes: int) -> DataFrame:
    """``doc_id, version, edges``: per text both edges of each run, with the text beside the first occurrence.

    ``edges`` is an array of (start, size, chunks, first_doc_id, side, near). An edge where either
    text ends has nothing beside it and is not looked up.
    """
    runs = settle(repeated_runs(docs, **sizes), "runs")
    common = ["doc_id", "version", "start", "size", "chunks", F.col("head.id").alias("first_doc_id")]
    left = runs.select(*common, F.lit(0).alias("side"), F.col("head").alias("spot"), (F.least("start", "head.at") > 0).alias("open"))
    right = runs.select(*common, F.lit(1).alias("side"), F.col("tail").alias("spot"), (~F.col("last")).alias("open"))
    edges = left.union(right)
    places = edges.where("open").select("spot.*", "side")
    near = settle(_surroundings(docs, places, reach), "near").select(F.struct("id", "version", "at").alias("spot"), "side", "near")
    both = edges.where("open").join(near, ["spot", "side"]).unionByName(edges.where("NOT open").withColumn("near", F.lit("")))
    edge = F.struct("start", "side", "size", "chunks", "first_doc_id", "near")
    return both.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(edge)).alias("edges"))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def grow(text: str, edges: list[dict], min_words: int) -> list[dict]:
    """Runs grown to both sides as far as the first occurrences go on alike, joined where they meet.

    Left out are runs that then have fewer than ``min_words`` words, cut ones included, and fewer
    than ``WORD_BYTES`` bytes for each of these.
    """
    spans = {}
    for e in edges:
        end = e["start"] + e["size"]
        span = spans.setdefault(e["start"], [e["start"], end, e["first_doc_id"], e["chunks"]])
        if e["side"]:
            span[1] += _shared(text[end : end + len(e["near"])], e["near"])
        else:
            span[0] -= _shared(text[max(0, e["start"] - len(e["near"])) : e["start"]][::-1], e["near"][::-1])
    joined = []
    for low, high, first, n in (spans[start] for start in sorted(spans)):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
            joined[-1][3] += n
        else:
            joined.append([low, high, first, n])
    runs = []
    for low, high, first, n in joined:
        passage = text[low:high]
        n_bytes = len(passage.encode("utf-8", "surrogatepass"))
        if n_bytes >= min_words * WORD_BYTES or len(passage.split()) >= min_words:
            runs.append({"start": low, "size": high - low, "bytes": n_bytes, "first_doc_id": first, "chunks": n})
    return runs


_RUNS = "array<struct<start:int,size:int,bytes:int,first_doc_id:bigint,chunks:int>>"


def _strip(min_words: int):
    """Column function: the runs that leave a text, and the text without them; null where a row has no edges."""

    @F.pandas_udf(f"runs {_RUNS}, text string")
    def strip(text: pd.Series, edges: pd.Series) -> pd.DataFrame:
        found, out = [], []
        for t, e in zip(text, edges, strict=True):
            runs = None if e is None else grow(t, list(e), min_words)
            found.append(runs)
            if not runs:
                out.append(None)
                continue
            ends = [0, *(r["start"] + r["size"] for r in runs)]
            out.append("".join(t[a:b] for a, b in zip(ends, [*(r["start"] for r in runs), len(t)], strict=True)))
        return pd.DataFrame({"runs": pd.Series(found, dtype=object), "text": pd.Series(out, dtype=object)})

    return strip


def strip_repeats(docs: DataFrame, runs_col: str = "runs", min_words: int = MIN_WORDS, reach: int = REACH, **sizes: int) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and column ``runs_col`` (empty where nothing was).

    ``runs_col`` is an array of (start, size, bytes, first_doc_id, chunks) in text order, in
    characters of the old text. Every row stays, also one whose whole text is a repeat; its text is
    then empty. Null text stays null. ``n_chars`` follows the new text if it is a column. A run
    grows by at most ``reach`` characters to each side.
    """
    found = settle(_edged_runs(docs, reach, **sizes), "repeats").select(
        F.col("doc_id").alias("_llm_id"), F.col("version").alias("_llm_version"), F.col("edges").alias("_llm_edges"),
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & (F.xxhash64("text") == F.col("_llm_version"))
    rows = docs.drop(runs_col).join(found, same, "left")
    cut = _strip(min_words)(F.when(F.col("_llm_edges").isNotNull(), F.col("text")), F.col("_llm_edges"))
    rows = rows.withColumn("_llm_cut", cut).withColumn(runs_col, F.coalesce(F.col("_llm_cut.runs"), F.array().cast(_RUNS)))
    out = rows.withColumn("text", F.when(F.size(runs_col) > 0, F.col("_llm_cut.text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(runs_col) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[c for c in docs.columns if c != runs_col], runs_col)
