"""Alignment of two tokenizers over the same texts, by byte offsets, in Arrow tables.

Token lists of a batch are flattened with the index of their document; a cumulative sum of token
sizes, started anew at each document, gives every token's end. A full outer hash join of both
tokenizers' ends on (document, end) and a sort by that key cut the bytes into intervals, each
covered by one token of either side: a link. Ends that both sides have close a group.

Links are written once, per document and distinct pair. Pair counts are summed by Arrow per batch
and task, then by Spark. A document meets the counts of its pairs in two ways: the few pairs that
hold a fixed share of all links travel to the tasks, all others are joined.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import settle, slices
from dossier.llm.packing import _BYTE_OF, _ODD, _RUN, WORDS

# Pairs that hold more than one in HOT of all links go to the tasks; there are at most HOT of them (5 MB).
HOT = 1 << 18
# Rows of partial pair counts that a task holds before it sums them, and hands on.
HELD = 1 << 20
_SPACE = "▁"


class ByteLevel:
    """Ids of a byte-level tokenizer's file, special strings taken as plain text, and the bytes of each id.

    The merges run in a faster library where the file parts texts in the usual way (``WORDS``, no
    normaliser); any other file, and texts on which the two may differ, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        parts = spec.get("pre_tokenizer") or {}
        usual = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space") and not spec.get("normalizer")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        held = {i: bytes(map(_BYTE_OF.__getitem__, token)) for token, i in vocab.items() if all(c in _BYTE_OF for c in token)}
        self.bytes = [held.get(i, b"") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.fast = None
        if usual:
            import tiktoken

            self.fast = tiktoken.Encoding("from-file", pat_str=WORDS, mergeable_ranks={b: i for i, b in held.items()}, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            plain = self.fast is None or _ODD.search(text) or _RUN.search(text)
            out.append(self.tokenizer.encode(text, add_special_tokens=False).ids if plain else self.fast.encode_ordinary(text))
        return out


class Pieces:
    """Ids of a piece tokenizer's model and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class _Side:
    """A tokenizer with the Arrow columns that its ids index."""

    def __init__(self, encode):
        self.encode = encode
        self.bytes = pa.array(encode.bytes, pa.large_binary())
        self.sizes = pc.binary_length(self.bytes).cast(pa.int64())


@functools.cache
def _sides(path_a: str, path_b: str) -> tuple[_Side, _Side, pa.Array]:
    """Both sides, and the decimal ids as text: first A with ``,`` or ``|`` behind them, then B with ``,`` or ``;``."""
    a, b = _Side(ByteLevel(path_a)), _Side(Pieces(path_b))
    texts = [f"{i}{m}" for i in range(len(a.bytes)) for m in ",|"] + [f"{i}{m}" for i in range(len(b.bytes)) for m in ",;"]
    return a, b, pa.array(texts, pa.large_string())


def _runs(values: pa.Array, counts: np.ndarray) -> list[memoryview]:
    """The joined bytes of every document's run of values."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    ends = at[np.concatenate(([0], np.cumsum(counts)))]
    data = memoryview(values.buffers()[2] or b"").cast("B")
    return [data[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _tokens(lists: pa.ListArray, side: _Side, name: str) -> pa.Table:
    """``doc, end, <name>``: every token with its document's index and its end in that document's bytes."""
    doc, ids = pc.list_parent_indices(lists), pc.list_flatten(lists)
    total = pc.cumulative_sum(side.sizes.take(ids))
    upto = pa.concat_arrays([pa.array([0], pa.int64()), total])
    before = upto.take(lists.offsets.slice(0, len(lists)))
    return pa.table({"doc": doc.cast(pa.int64()), "end": pc.subtract(total, before.take(doc)), name: ids})


def _exclusive(flags: pa.Array) -> pa.Array:
    n = flags.cast(pa.int64())
    return pc.subtract(pc.cumulative_sum(n), n)


def _sequence(a_ids: np.ndarray, a_last: np.ndarray, b_ids: np.ndarray, b_last: np.ndarray, n_a: int) -> np.ndarray:
    """Places in the table of decimal ids, group by group, A before B; ``*_last`` marks a group's last token."""
    a_end, b_end = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    b_start = np.concatenate(([0], b_end[:-1]))
    at_a = np.arange(len(a_ids)) + b_start[np.cumsum(a_last) - a_last]
    at_b = np.arange(len(b_ids)) + a_end[np.cumsum(b_last) - b_last]
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    out[at_a] = a_ids * 2 + a_last
    out[at_b] = 2 * n_a + b_ids * 2 + b_last
    return out


def align_texts(texts: list[str | None], path_a: str, path_b: str) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Counts and group texts' digests of every text, and ``doc, a, b, n``: links of each distinct pair.

    Texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens.
    """
    side_a, side_b, decimals = _sides(path_a, path_b)
    given = [i for i, text in enumerate(texts) if text]
    whole = [b" " + texts[i].encode("utf-8", "surrogatepass") for i in given]
    lists = {}
    fits = np.ones(len(given), bool)
    for side, asked in ((side_a, [" " + texts[i] for i in given]), (side_b, [texts[i] for i in given])):
        lists[side] = pa.array(side.encode(asked), pa.list_(pa.int32()))
        counts = pc.list_value_length(lists[side]).to_numpy(zero_copy_only=False)
        fits &= np.array([run == text for run, text in zip(_runs(side.bytes.take(pc.list_flatten(lists[side])), counts), whole, strict=True)], bool)
    docs = np.array(given, np.int64)[fits]
    out = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [""] * len(texts)
    pairs = pa.table({"doc": pa.array([], pa.int64()), "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    if not len(docs):
        return out, digests, pairs
    own = {s: lists[s].filter(pa.array(fits)) for s in (side_a, side_b)}
    n_a, n_b = (pc.list_value_length(own[s]).to_numpy().astype(np.int64) for s in (side_a, side_b))
    ids_a, ids_b = pc.list_flatten(own[side_a]), pc.list_flatten(own[side_b])
    ends = _tokens(own[side_a], side_a, "a").join(
        _tokens(own[side_b], side_b, "b"), keys=["doc", "end"], join_type="full outer", coalesce_keys=True, use_threads=False,
    ).sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    has_a, has_b = (ends.column(x).is_valid().combine_chunks() for x in "ab")
    shared = pc.and_(has_a, has_b)
    links = pa.table({
        "doc": ends.column("doc"), "a": ids_a.take(_exclusive(has_a)), "b": ids_b.take(_exclusive(has_b)), "shared": shared.cast(pa.int64()),
    })
    by_doc = links.group_by("doc", use_threads=False).aggregate([("shared", "sum"), ([], "count_all")]).sort_by("doc")
    out["n_a"][docs], out["n_b"][docs] = n_a, n_b
    out["n_groups"][docs], out["n_links"][docs] = by_doc["shared_sum"].to_numpy(), by_doc["count_all"].to_numpy()
    last_a, last_b = (shared.filter(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (has_a, has_b))
    order = _sequence(ids_a.to_numpy().astype(np.int64), last_a, ids_b.to_numpy().astype(np.int64), last_b, len(side_a.bytes))
    for doc, text in zip(docs.tolist(), _runs(decimals.take(pa.array(order)), n_a + n_b), strict=True):
        digests[doc] = hashlib.sha256(text[:-1]).hexdigest()
    grouped = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
    pairs = pa.table({"doc": pa.array(docs).take(grouped["doc"].combine_chunks()), "a": grouped["a"], "b": grouped["b"], "n": grouped["count_all"]})
    return out, digests, pairs.sort_by([("doc", "ascending"), ("a", "ascending"), ("b", "ascending")])


def _by_text(pairs: pa.Table, n: int) -> list[pa.Array]:
    """Columns ``a, b, n`` as one list for each of ``n`` texts."""
    counts = np.bincount(pairs["doc"].to_numpy(), minlength=n)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pairs[x].combine_chunks().cast(pa.int32())) for x in ("a", "b", "n")]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LINKS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for every row of ``docs``: counts, the digest of its groups, and its distinct pairs with their links.

    ``row`` names the row (ids may repeat or be null). Both files must be readable by every executor.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = [field.split()[0] for field in LINKS.split(", ")]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            found, digests, pairs = align_texts(batch.column(1).to_pylist(), path_a, path_b)
            rows_ = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows_, batch.column(0), *[pa.array(found[x]) for x in COUNTS], pa.array(digests, pa.string()), *_by_text(pairs, batch.num_rows)], names=names,
            )

    return rows.mapInArrow(run, LINKS)


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns(["a", "b", "n"])


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a, b, n``: links of every pair over all documents; tasks sum their own before the shuffle."""

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            flat = [pc.list_flatten(batch.column(i)) for i in range(3)]
            held.append(_summed([pa.table({"a": flat[0], "b": flat[1], "n": flat[2].cast(pa.int64())})]))
            if sum(len(t) for t in held) > HELD:
                held = [_summed(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _summed(held).to_batches()

    return linked.select("a", "b", "n").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def _meet_hot(linked: DataFrame, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """``row, doc_id, counts, digest, n_best, count_sum, rest``: sums over hot pairs; ``rest`` holds all other pairs."""
    head = [field for field in LINKS.split(", ")[:7]]
    schema = ", ".join([*head, "n_best long", "count_sum long", "rest array<struct<a:int,b:int,n:int>>"])
    names = [field.split()[0] for field in head] + ["n_best", "count_sum", "rest"]

    def run(batches):
        codes, counts, best = hot
        for batch in batches:
            lists = [batch.column(i) for i in (7, 8, 9)]
            a, b, n = (pc.list_flatten(x).to_numpy() for x in lists)
            row = pc.list_parent_indices(lists[0]).to_numpy()
            code = _code(a, b)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            here = at[known]
            np.add.at(sums[0], row[known], n[known] * best[here])
            np.add.at(sums[1], row[known], n[known] * counts[here])
            rest = ~known
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[rest], minlength=batch.num_rows)))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(x[rest].astype(np.int32)) for x in (a, b, n)], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=names,
            )

    return linked.mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts the links whose pair is the most frequent of its B id in all documents (ties
    included), ``count_sum`` adds the pairs' counts over the links. Null and empty texts and texts
    that do not come back byte for byte give zeros and ''; repeated rows and null ids are rows like
    others; further columns are not read; an empty table gives no row.
    """
    linked = settle(links(docs, path_a, path_b), "links")
    counted = settle(pair_counts(linked), "pairs")
    highest = counted.groupBy("b").agg(F.max("n").alias("high"))
    known = settle(counted.join(highest, "b").select("a", "b", F.col("n").alias("total"), (F.col("n") == F.col("high")).alias("best")), "known")
    everything = known.agg(F.coalesce(F.sum("total"), F.lit(0))).scalar()
    is_hot = F.col("total") * hot > everything
    rows = known.where(is_hot).toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    a, b, total, best = (rows[x].to_numpy() for x in ("a", "b", "total", "best"))
    met = settle(_meet_hot(linked, (_code(a, b), total, best.astype(np.int64))), "met")
    rest = met.select("row", F.explode("rest").alias("p")).select("row", "p.*").join(known.where(~is_hot), ["a", "b"])
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("best_rest"), F.sum(F.col("n") * F.col("total")).alias("sum_rest"))
    added = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return met.drop("rest").join(rest, "row", "left").select("doc_id", *COUNTS, added("n_best", "best_rest"), added("count_sum", "sum_rest"), "groups_sha256")
