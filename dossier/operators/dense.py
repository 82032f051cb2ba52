"""Exact nearest chunks by cosine, for many queries at once.

The product of a block of query vectors and a batch of chunk vectors runs in numpy inside the
task; each task passes on only the best ``n`` per query, so nothing grows with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.session import cut_lineage

# Query vectors of this many bytes (as doubles) travel to every task at once; more go block by block.
BLOCK_BYTES = 64 << 20
QUERY_BLOCK = 1024
CHUNK_BATCH = 4096
# Chunks in which a query's first floor is looked for, and products that are scored again at once.
FIRST_LOOK, HITS = 512, 1 << 18
SCORE_DIGITS = 9
_ANY, _UNKNOWN = -1, -2


def _unit_rows(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Row matrix of unit length in double precision; a zero vector stays zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def _codes(column: pa.ChunkedArray | pa.Array, known: pa.Array, missing: int) -> np.ndarray:
    """Place of each value in the queries' distinct values, ``missing`` for all others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.index_in(column.cast(pa.string()), value_set=known), missing).to_numpy(zero_copy_only=False)


class _Best:
    """Best ``n`` (score down, chunk id up) per query row, folded batch by batch for one block of queries at a time."""

    def __init__(self, n: int):
        self.n = n
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def floor(self, low: int, size: int) -> np.ndarray:
        """The n-th best score of each query of a block so far; minus infinity where there are fewer."""
        out = np.full(size, -np.inf)
        if low in self.blocks:
            row, score, _ = self.blocks[low]
            start, count = np.unique(row, return_index=True, return_counts=True)[1:]
            full = count >= self.n
            out[row[start[full]]] = score[start[full] + self.n - 1]
        return out

    def add(self, low: int, row: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> None:
        if low in self.blocks:
            row, score, chunk = (np.concatenate(x) for x in zip(self.blocks[low], (row, score, chunk), strict=True))
        order = np.lexsort((chunk, -score, row))
        row, score, chunk = row[order], score[order], chunk[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.n
        self.blocks[low] = row[keep], score[keep], chunk[keep]


def _fold(
    best: _Best, queries: dict, chunk_ids: np.ndarray, chunk_unit: np.ndarray,
    chunk_codes: Sequence[np.ndarray], n: int, skip_same_id: bool,
) -> None:
    """Products in single precision, whose error ``slack`` bounds, sort out what cannot reach a query's list; the rest is scored in double."""
    thin, width = chunk_unit.astype(np.float32).T, len(chunk_unit)
    slack = (chunk_unit.shape[1] + 16) * 2.0**-23 + 10.0**-SCORE_DIGITS
    for lo in range(0, len(queries["unit"]), QUERY_BLOCK):
        unit, key = queries["unit"][lo : lo + QUERY_BLOCK], queries["key"][lo : lo + QUERY_BLOCK]
        scores = unit.astype(np.float32) @ thin
        for wanted, present in zip(queries["codes"], chunk_codes, strict=True):
            wanted = wanted[lo : lo + QUERY_BLOCK, None]
            scores[(wanted != _ANY) & (wanted != present[None, :])] = -np.inf
        floor = best.floor(lo, len(unit))
        new, look = np.flatnonzero(floor == -np.inf), min(width, max(FIRST_LOOK, 4 * n))
        if len(new) and look > n:
            first = scores[new, :look]
            first[np.isnan(first)] = -np.inf
            if skip_same_id:
                first[key[new, None] == chunk_ids[None, :look]] = -np.inf
            floor[new] = np.partition(first, look - n, axis=1)[:, look - n] - slack
        rows, cols = np.nonzero(scores >= (floor - slack).astype(np.float32)[:, None])
        for at in range(0, len(rows), HITS):
            row, col = rows[at : at + HITS], cols[at : at + HITS]
            hit = scores[row, col] > -np.inf
            if skip_same_id:
                hit &= key[row] != chunk_ids[col]
            row, col = row[hit], col[hit]
            exact = np.round(np.einsum("ij,ij->i", unit[row], chunk_unit[col]), SCORE_DIGITS) + 0.0
            hit = exact >= floor[row]
            if hit.any():
                best.add(lo, row[hit], exact[hit], chunk_ids[col[hit]])


def _queries_as_arrays(table: pa.Table, query_id: str, vector: str, filters: Sequence[str]) -> dict:
    known = []
    for f in filters:
        values = pc.unique(table.column(f).combine_chunks().cast(pa.string())).drop_null()
        known.append(values.filter(pc.not_equal(values, "")))
    return {
        "known": known,
        "ids": table.column(query_id).combine_chunks(),
        "key": _keys(table.column(query_id)),
        "unit": _unit_rows(table.column(vector)),
        "codes": [_codes(table.column(f), k, _ANY) for f, k in zip(filters, known, strict=True)],
    }


def _result(best: _Best, queries: dict, names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    if not best.blocks:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=list(names))
    row = np.concatenate([low + row for low, (row, _, _) in best.blocks.items()])
    score, chunk = (np.concatenate([block[i] for block in best.blocks.values()]) for i in (1, 2))
    return pa.RecordBatch.from_arrays(
        [
            queries["ids"].take(pa.array(row)).cast(types[0]),
            pa.array(chunk.tolist(), types[1]),
            pa.array(score, types[2]),
        ],
        names=list(names),
    )


def dense_topk(
    queries: DataFrame,
    chunks: DataFrame,
    n: int,
    *,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    filters: Sequence[str] = (),
    skip_same_id: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(query_id, chunk_id, dense_score, dense_rank)``: the best ``n`` chunks of each query.

    ``filters`` name columns on both sides that must agree where the query's value is neither null
    nor ``''``; they are applied before ranking. Equal scores are ordered by chunk id.

    The queries are a stated set. They go to the tasks in blocks of at most ``block_bytes`` of
    vectors; each block is held against every chunk where the chunk lies, so chunks are neither
    shuffled nor copied, and a task passes on ``n`` rows per query. More queries mean more blocks
    of the same plan.
    """
    q = cut_lineage(queries.select(query_id, vector, *filters).where(F.col(vector).isNotNull()))
    c = chunks.select(chunk_id, vector, *filters).where(F.col(vector).isNotNull())
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(chunk_id, chunks.schema[chunk_id].dataType),
            T.StructField("dense_score", T.DoubleType()),
        ]
    )
    names = schema.fieldNames()
    held = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).first()
    blocks = max(1, -(-held["n"] * (held["width"] or 0) * 8 // block_bytes))

    def scanned(block: pa.Table) -> DataFrame:
        shared = q.sparkSession.sparkContext.broadcast(_queries_as_arrays(block, query_id, vector, filters))
        query_type = _plain(block.schema.field(query_id).type)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qs, best, id_type = shared.value, _Best(n), None
            for batch in batches:
                for lo in range(0, batch.num_rows, CHUNK_BATCH):
                    part = batch.slice(lo, CHUNK_BATCH)
                    id_type = _plain(part.schema.field(chunk_id).type)
                    _fold(
                        best, qs, _keys(part.column(chunk_id)), _unit_rows(part.column(vector)),
                        [_codes(part.column(f), k, _UNKNOWN) for f, k in zip(filters, qs["known"], strict=True)], n, skip_same_id,
                    )
            if id_type is not None:
                yield _result(best, qs, names, [query_type, id_type, pa.float64()])

        return c.mapInArrow(scan, schema)

    parts = []
    for i in range(blocks):
        block = q.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i).toArrow()
        if block.num_rows:
            parts.append(scanned(block))
    local = reduce(DataFrame.unionByName, parts) if parts else q.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy(query_id).orderBy(F.desc("dense_score"), F.asc(chunk_id))
    return local.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= n)


def _plain(kind: pa.DataType) -> pa.DataType:
    return pa.string() if pa.types.is_large_string(kind) else kind
