"""Phrase collocations per language, grown best first from counts of their prefixes.

Texts are lower-cased (A-Z only) and cut into pieces, pieces into words; a phrase never crosses a
piece. For a phrase of count ``a``, cut into two parts of counts ``l`` and ``r``, the score is
floor(1,000,000 a a / (l r)) of its lowest-scoring cut. Three facts bound what a phrase can reach:

- a phrase is no more frequent than any part of it, so only frequent words and pairs are grown;
- cut after its first word, a phrase that begins with a pair of count ``p`` has r >= a and a <= p,
  so it scores at most floor(1,000,000 p / f(first word)): the pair's bound, which is never below
  the pair's own score;
- a pair is dropped for a longer phrase around it, so it is settled once all phrases that begin or
  end with it are counted.

Words and pairs are counted over all texts. Then pairs are grown in rounds, highest bounds first:
a round lowers the level of each unsettled language, grows every pair whose bound reaches it, and
asks whether the surviving phrases at or above the level fill the list. If they do, nothing below
the level can enter, ties included. Otherwise the next round goes deeper, at last to zero.

Which words and pairs a round grows reaches the tasks as a bitmap of fixed size over their hashes.
A collision makes a task count a phrase in vain; it never hides one, and all counts are of the
phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import mix, settle

LEAST, LIMIT, UNKNOWN = 10, 2000, "und"
# Millionths, and the share of a phrase's count (percent) at which a longer phrase takes its place.
SCALE, SHARE = 1_000_000, 50
# Bits of a bitmap (a power of two; 4 MB) and text bytes that a task counts at once.
FILTER_BITS, BLOCK = 1 << 25, 8 << 20
_MARK = 0xFF  # stands for a piece's end; no byte of UTF-8 text
_BYTES = bytearray(range(256))
_BYTES[65:91] = bytes(range(97, 123))
for _byte in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_byte] = _MARK
_BYTES[0x09] = 0x20


def _blocks(texts: list[bytes], size: int) -> Iterator[bytes]:
    """The texts, lower-cased and with marked ends of pieces, in blocks of about ``size`` bytes.

    Long texts are cut at ends of pieces, which no phrase crosses; a piece stays whole.
    """
    held, n = [], 0
    for text in texts:
        line = text.translate(bytes(_BYTES))
        low = 0
        while len(line) - low > size:
            cut = line.rfind(b"\xff", low, low + size)
            cut = line.find(b"\xff", low + size) if cut < 0 else cut
            if cut < 0:
                break
            yield line[low:cut]
            low = cut + 1
        held.append(line[low:] if low else line)
        n += len(held[-1])
        if n >= size:
            yield b"\xff".join(held)
            held, n = [], 0
    if held:
        yield b"\xff".join(held)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64(bits - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & np.uint8(1) == 1


def _word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """64-bit hashes of words (as bytes) of one language."""
    salt = pd.util.hash_array(np.array([lang], object))
    return mix(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) ^ salt)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first ^ mix(second))


def _counted(lang: str, words: list[pa.Array], n: np.ndarray) -> pa.RecordBatch:
    phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")
    phrase = pc.cast(phrase, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "a"])


def _count_block(block: bytes, lang: str, size: int, maps: dict[str, np.ndarray], bits: int) -> pa.RecordBatch | None:
    """Counts of the block's phrases of ``size`` words that the bitmaps let through."""
    tokens = pa.array(block.replace(b"\xff", b" \xff ").split(), pa.binary()).dictionary_encode()
    words, at = tokens.dictionary, tokens.indices.to_numpy()
    if not len(words):
        return None
    mark = pc.index(words, pa.scalar(b"\xff", pa.binary())).as_py()
    inside = at != mark
    if size == 1:
        n = np.bincount(at, minlength=len(words))
        if mark >= 0:
            n[mark] = 0
        kept = np.flatnonzero(n)
        return _counted(lang, [words.take(pa.array(kept))], n[kept])
    hashes = _word_hashes(words, lang)
    frequent = _has(maps["words"], _slots(hashes, bits))[at] & inside
    paired = frequent[:-1] & frequent[1:]
    if size == 2:
        first = np.flatnonzero(paired)
        codes, n = np.unique(at[first].astype(np.int64) * len(words) + at[first + 1], return_counts=True)
        return _counted(lang, [words.take(pa.array(codes // len(words))), words.take(pa.array(codes % len(words)))], n)
    first = np.flatnonzero(paired)
    slots = _slots(_pair_hashes(hashes[at[first]], hashes[at[first + 1]]), bits)
    states = {}
    for name in ("pairs", "right", "left"):
        states[name] = np.zeros(len(at), bool)
        states[name][first] = _has(maps[name], slots)
    pairs, right, left = (states[x] for x in ("pairs", "right", "left"))
    start = np.flatnonzero(pairs[:-1] & pairs[1:] & (right[:-1] | left[1:]))
    heads, at_head = np.unique(at[start].astype(np.int64) * len(words) + at[start + 1], return_inverse=True)
    codes, n = np.unique(at_head * len(words) + at[start + 2], return_counts=True)
    heads = heads[codes // len(words)]
    return _counted(lang, [words.take(pa.array(x)) for x in (heads // len(words), heads % len(words), codes % len(words))], n)


def count_phrases(docs: DataFrame, size: int, maps: dict[str, bytes], bits: int = FILTER_BITS) -> DataFrame:
    """``lang, phrase, a`` of all phrases of ``size`` words that the bitmaps let through.

    A task sums each block of text before it hands its rows on, and Spark sums again before the
    shuffle, so a frequent phrase is a few rows whatever its count.
    """

    def run(batches):
        held = {name: np.frombuffer(value, np.uint8) for name, value in maps.items()}
        texts: dict[str, list[bytes]] = {}
        n = 0

        def flush():
            for lang, own in texts.items():
                for block in _blocks(own, BLOCK):
                    out = _count_block(block, lang, size, held, bits)
                    if out is not None and out.num_rows:
                        yield out
            texts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
                n += len(text)
                if n >= 2 * BLOCK:
                    yield from flush()
                    n = 0
        yield from flush()

    rows = docs.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, phrase string, a long")
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def bitmap(rows: DataFrame, words: list[str], bits: int = FILTER_BITS) -> bytes:
    """Bits of the hashes of the rows' words or pairs; ``bits`` / 8 bytes, whatever the number of rows."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            parts = [batch.column(1 + i).cast(pa.binary()) for i in range(len(words))]
            hashes = np.zeros(batch.num_rows, np.uint64)
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                each = [_word_hashes(p.filter(pa.array(own)), lang) for p in parts]
                hashes[own] = each[0] if len(each) == 1 else _pair_hashes(*each)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(hashes, bits)))], names=["slot"])

    slots = rows.select("lang", *words).mapInArrow(run, "slot long")
    # bitmap_bucket_number counts slots from 1 on.
    parts = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        piece = np.frombuffer(row["bits"], np.uint8)
        out[(row["part"] - 1) * 4096 : (row["part"] - 1) * 4096 + len(piece)] = piece[: len(out) - (row["part"] - 1) * 4096]
    return out.tobytes()


def _score(a: str, left: str, right: str) -> Column:
    """Exact: products are decimals of 38 digits."""
    return F.expr(f"cast((cast({a} as decimal(18,0)) * {a} * {SCALE}) div (cast({left} as decimal(18,0)) * {right}) as bigint)")


def nth_score(rows: DataFrame, nth: int) -> DataFrame:
    """``lang, level``: the score of each language's ``nth`` best row; 0 where it has fewer.

    Scores are at most ``SCALE``, so a language's histogram is bounded and no row is sorted.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("lang", "score").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
    return sums.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= nth, F.col("score"))), F.lit(0)).alias("level"))


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, w1, w2, phrase, a, l, r, score, bound`` of frequent pairs."""
    parts = F.split("phrase", " ")
    of = lambda w, n: words.select("lang", F.col("phrase").alias(w), F.col("a").alias(n))
    rows = pairs.select("lang", "phrase", "a", parts[0].alias("w1"), parts[1].alias("w2"))
    rows = rows.join(of("w1", "l"), ["lang", "w1"]).join(of("w2", "r"), ["lang", "w2"])
    bound = F.expr(f"cast((cast(a as decimal(18,0)) * {SCALE}) div l as bigint)")
    return rows.select("lang", "w1", "w2", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"), bound.alias("bound"))


def _scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, w1, w2, w3, phrase, a, l, r, score`` of frequent triples by their lowest-scoring cut."""
    parts = F.split("phrase", " ")
    rows = triples.where(F.col("a") >= LEAST).select("lang", "phrase", "a", *[parts[i].alias(f"w{i + 1}") for i in range(3)])
    heads = pairs.select("lang", "w1", "w2", F.col("l").alias("l1"), F.col("a").alias("l2"))
    tails = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    rows = rows.join(heads, ["lang", "w1", "w2"]).join(tails, ["lang", "w2", "w3"])
    rows = rows.select("*", _score("a", "l1", "r1").alias("s1"), _score("a", "l2", "r2").alias("s2"))
    first = F.col("s1") <= F.col("s2")
    return rows.select(
        "lang", "w1", "w2", "w3", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )


def _survivors(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Pairs that no triple around them replaces, and all triples."""
    ends = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    around = ends.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    left = pairs.join(around, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < SHARE * F.col("a"), F.lit(True)))
    names = ["lang", "phrase", "a", "l", "r", "score"]
    return left.select(*names).unionByName(triples.select(*names))


def mine(docs: DataFrame, limit: int = LIMIT, bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``limit`` phrases of two or three words.

    Null text is empty, a null language counts as ``und``, repeated rows count each time; other
    columns are not read. An empty table, or one without a phrase of ``LEAST`` occurrences, gives no row.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    counted = settle(count_phrases(rows, 1, {}, bits), "words")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    words = counted.where(F.col("a") >= LEAST)
    maps = {"words": bitmap(words, ["phrase"], bits)}
    frequent = settle(count_phrases(rows, 2, maps, bits).where(F.col("a") >= LEAST), "pairs")
    pairs = settle(_scored_pairs(frequent, words), "scored")
    maps["pairs"] = bitmap(pairs, ["w1", "w2"], bits)

    seen, settled, open_ = None, None, settle(pairs.select("lang").distinct(), "open")
    depth, before = 2 * limit, None
    while not open_.isEmpty():
        level = nth_score(pairs.join(open_, "lang", "left_semi"), depth)
        if before is not None:
            level = level.join(before, "lang")
        level = settle(level, "level")
        here = pairs.join(level, "lang")
        fresh = lambda c: (F.col(c) >= F.col("level")) & (F.lit(True) if before is None else F.col(c) < F.col("above"))  # noqa: E731, B023
        maps["right"] = bitmap(here.where(fresh("bound")), ["w1", "w2"], bits)
        maps["left"] = bitmap(here.where(fresh("score")), ["w1", "w2"], bits)
        grown = settle(_scored_triples(count_phrases(rows, 3, maps, bits), pairs, words), "triples")
        seen = grown if seen is None else settle(seen.unionByName(grown).dropDuplicates(["lang", "phrase"]), "triples")
        levels = level.select("lang", "level")
        reached = F.col("score") >= F.col("level")
        alive = settle(_survivors(here.where(reached), seen).join(levels, "lang").where(reached), "alive")
        full = alive.groupBy("lang").agg(F.count("*").alias("n_alive"))
        state = settle(levels.join(full, "lang", "left").select("lang", "level", ((F.coalesce("n_alive", F.lit(0)) >= limit) | (F.col("level") == 0)).alias("done")), "state")
        done = alive.drop("level").join(state.where("done").select("lang"), "lang", "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        before = state.where("NOT done").select("lang", F.col("level").alias("above"))
        open_ = before.select("lang")
        depth *= 4
    if settled is None:
        settled = pairs.select("lang", "phrase", "a", "l", "r", "score")

    enough = settled.join(nth_score(settled, limit), "lang").where(F.col("score") >= F.col("level"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = enough.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
