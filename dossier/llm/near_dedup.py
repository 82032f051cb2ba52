"""Near-duplicate documents by Order MinHash over five-word shingles, verified by banded alignment.

Shingles are labelled with their occurrence number, so each is unique in its text. An alignment of
two texts keeps M shingles in the same order; the texts are near copies if M / (m + n - M) >= 0.8 for
m and n shingles.
"""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import mix, settle, shingles, slices, word_hashes
from dossier.llm.graph import components
from dossier.llm.omh import label_occurrences, sketch

SHINGLE, SIZE, TUPLE, ALIKE, BANDS = 5, 48, 2, 0.8, 40
# Members and shingles of a block when a bucket's pairs are compared, and the size of the matrices used for it.
CROWD, GRAMS, ROWS, COLUMNS = 4000, 1 << 22, 256, 2048


def longest_rise(values: np.ndarray) -> int:
    """Length of the longest strictly rising subsequence."""
    if (values[1:] > values[:-1]).all():
        return len(values)
    ends: list[int] = []
    for v in values.tolist():
        at = bisect_left(ends, v)
        if at == len(ends):
            ends.append(v)
        else:
            ends[at] = v
    return len(ends)


def labelled(text: str | None) -> np.ndarray:
    return label_occurrences(shingles(word_hashes(text), SHINGLE))


def near(a: np.ndarray, b: np.ndarray, alike: float = ALIKE) -> bool:
    """Whether two labelled shingle sequences are near copies.

    An alignment that is near enough drops few shingles, so its matches lie inside a band around the
    diagonal; matches outside are not looked at.
    """
    total = len(a) + len(b)
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not total or len(common) < alike * (total - len(common)) - 1e-9:
        return False
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    kept = longest_rise(at_b[np.abs(at_a - at_b) <= (1 - alike) / (1 + alike) * total + 1])
    return kept >= alike * (total - kept) - 1e-9


_PICKED = np.array([sorted(random.Random(i).sample(range(SIZE), 3)) for i in range(BANDS)])


def _bands(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    parts = sketch(shingles(words, SHINGLE), SIZE, TUPLE)[_PICKED]
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(3):
        out = mix(out ^ parts[:, i])
    return out


def _digest(text: str, words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes() if len(words) else text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, keys``: digest of the word sequence (of the text if it has no words) and the bands.

    A band is three components of the sketch. Texts that only share a passage agree in few components, near
    copies in most, and three at once tell them apart: if components agree with a chance of 0.64, a pair
    misses all bands with one of about 0.0005. Texts that agree in all words are exact copies here; null counts as empty;
    texts without words have no bands.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))

    def run(batches):
        for batch in slices(batches):
            digests, keys = [], []
            for text in batch.column(1).to_pylist():
                words = word_hashes(text)
                digests.append(_digest(text, words))
                keys.append(_bands(words).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"],
            )

    return rows.mapInArrow(run, "doc_id long, digest binary, keys array<long>")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b, linked`` of every pair by alignment of the whole texts."""
    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    texts = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(needed, "doc_id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b",
    ).select("a", "b", "text_a", "text_b")

    def run(batches):
        last, words = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            states = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != last:
                    last, words = b, labelled(b)
                states.append(near(labelled(a), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, pa.bool_())], names=["a", "b", "linked"])

    return settle(both.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")), "verified")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray], classes_left: np.ndarray, classes_right: np.ndarray) -> np.ndarray:
    """Labelled shingles that each left text has in common with each right text of another class.

    Only shingles that stand in more than one class are counted, by products of 0/1 matrices.
    """
    side = np.concatenate(left + right)
    text = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(side, kind="stable")
    fresh = np.flatnonzero(np.diff(side[order], prepend=side[order][:1] - np.uint64(1)) != 0)
    owner = np.concatenate((classes_left, classes_right))[text[order]]
    apart = np.minimum.reduceat(owner, fresh) != np.maximum.reduceat(owner, fresh) if len(fresh) else np.zeros(0, bool)
    column = np.repeat(np.cumsum(apart) - 1, np.diff(fresh, append=len(order)))
    used = np.repeat(apart, np.diff(fresh, append=len(order)))
    column, text = column[used], text[order][used]
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(apart.sum()), COLUMNS):
        here = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        held = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        held[text[here], column[here] - low] = 1
        common += held[: len(left)] @ held[len(left) :].T
    return common


def _resolve(ids: np.ndarray, classes: np.ndarray, keys: list[np.ndarray], grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, key: int) -> list[tuple[int, int]]:
    """Near copies ``(a, b)`` between members ``left`` and ``right`` of one bucket that join their classes.

    A pair is aligned only if the shingles in common allow it, if no earlier bucket holds it too, and
    if the links found so far do not join it already.
    """
    size = np.array([len(g) for g in grams], np.int64)
    parent = {c: c for c in np.unique(classes).tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for low in range(0, len(left), ROWS):
        part = left[low : low + ROWS]
        common = _shared_counts([grams[i] for i in part], [grams[j] for j in right], classes[part], classes[right])
        may = common >= ALIKE * (size[part][:, None] + size[right][None, :] - common) - 1e-3
        may &= (classes[part][:, None] != classes[right][None, :]) & (common > 0)
        for x, y in zip(*np.nonzero(may), strict=True):
            a, b = part[x], right[y]
            first, second = root(int(classes[a])), root(int(classes[b]))
            if first != second and np.intersect1d(keys[a], keys[b], assume_unique=True)[0] == key and near(grams[a], grams[b]):
                parent[first] = second
                out.append((int(ids[a]), int(ids[b])))
    return out


def _rest(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b``: near copies of different classes in the buckets ``members(key, doc_id, class)``, enough to join them.

    Every pair that a bucket holds is compared inside a task by its labelled shingles; no row stands
    for a pair. Large buckets (by members or shingles) are dealt into blocks, and a task takes two
    blocks, so none lies in one task.
    """
    open_ = settle(members.groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("keys")), "needed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(settle(open_.select("doc_id"), "ids"), "doc_id", "left_semi")

    def run(batches):
        for batch in slices(batches):
            own = [labelled(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in own], pa.int64()), pa.array([g.tobytes() for g in own], pa.binary())], names=["doc_id", "total", "grams"],
            )

    grams = settle(rows.mapInArrow(run, "doc_id long, total long, grams binary"), "grams")
    sized = settle(members.join(grams.select("doc_id", "total"), "doc_id"), "sized")
    of_key = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CROWD), F.ceil(F.sum("total") / GRAMS)).cast("int").alias("blocks"))
    dealt = settle(sized.join(of_key, "key").select("key", "doc_id", "class", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("own")), "dealt")
    each = dealt.select("key", "doc_id", "class", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "doc_id")

    def compare(name, table):
        key, i, j = (x.as_py() for x in name)
        own = table["own"].to_numpy()
        ids, classes = table["doc_id"].to_numpy(), table["class"].to_numpy()
        held = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        keys = [np.array(k, np.int64) for k in table["keys"].to_pylist()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if i == j:
            # A pair of different classes has a member outside the largest class.
            names, counts = np.unique(classes, return_counts=True)
            left = np.flatnonzero(classes != names[counts.argmax()])
        found = _resolve(ids, classes, keys, held, left, right, key)
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    whole = each.join(open_, "doc_id").join(grams.select("doc_id", "grams"), "doc_id")
    return settle(whole.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "rest")


def _star(members: DataFrame) -> DataFrame:
    """``key, a, b``: each member of a bucket with the bucket's centre (most company, then smallest id).

    Centres are cut out in each task before the shuffle and are written, so the join back on a bucket of any
    size is one that adaptive execution can split.
    """
    chosen = members.groupBy("key").agg(F.min(F.struct((-F.col("company")).alias("c"), "doc_id"))["doc_id"].alias("b"))
    return settle(members.join(settle(chosen, "centres"), "key").where("doc_id <> b").select("key", F.col("doc_id").alias("a"), "b"), "stars")


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one document, with the company each document keeps in all."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(keyed.join(counts, "key").select("key", "doc_id", "n"), "members")
    return members.drop("n").join(members.groupBy("doc_id").agg(F.sum("n").alias("company")), "doc_id")


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b``: near copies among distinct texts ``reps(rep, keys)``, enough to connect the classes.

    Buckets of equal bands are resolved by a star first: members are aligned with the bucket's centre, at
    most as many alignments as there are members, however large a bucket is. In buckets that still
    hold several classes, every pair of different classes is compared, so none is left out.
    """
    members = settle(_shared(reps.select(F.col("rep").alias("doc_id"), F.explode("keys").alias("key"))), "open")
    stars = _star(members)
    joined = verify(settle(stars.select("a", "b").distinct(), "pairs"), docs).where("linked").select("a", "b")
    known = components(joined)
    classed = settle(members.join(known, members["doc_id"] == known["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("class")), "classed")
    mixed = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    centres = stars.select("key", F.col("b").alias("doc_id")).distinct()
    left = settle(classed.join(mixed, "key", "left_semi").join(centres, ["key", "doc_id"], "left_anti"), "open")
    return joined.unionByName(_rest(left, docs))


def with_digest(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_llm_digest`` of each text, the one that ``sketches`` gives."""
    at, names = docs.columns.index("text"), [*docs.columns, "_llm_digest"]

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(t or "", word_hashes(t)) for t in batch.column(at).to_pylist()], pa.binary())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, _llm_digest binary")


def _nodes(texts: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``digest, rep, node, keys`` and the rows that hold the nodes' texts under ``doc_id``.

    A node is a text's smallest id. Where several texts have the same smallest id (an id was given
    twice), each gets a node of its own above all ids, and its rows are found by their digest.
    """
    twice = settle(texts.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep"), "twice")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if twice.isEmpty():
        return texts.withColumn("node", F.col("rep")), rows
    above = texts.agg(F.greatest(F.max("rep"), F.lit(0)) + 1).scalar()
    own = settle(texts.join(twice, "rep", "left_semi").select("digest", "rep", "keys", (F.monotonically_increasing_id() + above).alias("node")), "own")
    odd = with_digest(rows.join(twice, rows["doc_id"] == twice["rep"], "left_semi"))
    odd = odd.join(own.select(F.col("digest").alias("_llm_digest"), "node"), "_llm_digest").select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    nodes = texts.join(twice, "rep", "left_anti").withColumn("node", F.col("rep")).unionByName(own)
    return nodes, rows.join(twice, rows["doc_id"] == twice["rep"], "left_anti").unionByName(settle(odd, "odd"))


def _classed(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, class_id`` of every row with an id."""
    known = settle(sketches(docs), "sketches")
    texts = settle(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "distinct")
    nodes, rows = _nodes(texts, docs)
    joined = components(links(nodes.select(F.col("node").alias("rep"), "keys"), rows))
    grouped = settle(nodes.join(joined.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("digest", "rep", F.coalesce("component", "node").alias("class")), "grouped")
    named = settle(grouped.join(grouped.groupBy("class").agg(F.min("rep").alias("class_id")), "class").select("digest", "class_id"), "named")
    return known.select("doc_id", "digest").join(named, "digest")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept`` for every row; the class is named by its smallest id, which is kept.

    Exact copies share a representative before any pair is formed, so a text with any number of
    copies enters the search once. Null ids belong to no class and are kept. An id given to several
    texts may name a class for each of them; every text is searched, and each class keeps a row.
    """
    out = _classed(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    return out.unionByName(docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: one document of each class stays, columns unchanged.

    Of rows equal in id and text one stays; different texts under one id are documents of their own.
    """
    known = settle(_classed(docs), "classes")
    gone = settle(known.where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    repeated = settle(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(gone, "doc_id", "left_anti").join(repeated, "doc_id", "left_anti").select(*docs.columns)
    kept = known.where("doc_id = class_id").join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("_llm_id"), F.col("digest").alias("_llm_kept")).distinct()
    several = with_digest(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    several = several.join(settle(kept, "kept"), (several["doc_id"].cast("long") == F.col("_llm_id")) & (several["_llm_digest"] == F.col("_llm_kept")), "left_semi")
    return once.unionByName(several.dropDuplicates(["doc_id", "_llm_digest"]).select(*docs.columns))
