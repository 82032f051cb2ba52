"""Exact best-n searches over a stored index, reading only what can reach the list.

Lexical: a first look at the levels of highest bounds gives each query a floor, the n-th best of
partial scores. A level of a term is left out where its greatest weight, with the greatest of all
other terms, stays below the floor. Lists of the other levels are dealt by block of chunks, so a
task adds up the scores of its chunks and passes on a block's best that reach the floor; no occurrence is
shuffled by itself, and ids and payload are met by what is left.

Dense: the cosine with a member of a cell is at most cos(angle to the centre - radius). Cells are
visited in the order of that bound until they hold enough vectors, which gives the floor; then all
further cells whose bound reaches it.

Both bounds hold for every chunk, so the result is that of a full search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.dense import CHUNK_BATCH, SCORE_DIGITS, _Best, _codes, _fold, _keys, _plain, _queries_as_arrays, _result, _unit_rows, _UNKNOWN
from dossier.operators.sparse import PAIRS, QUERY_TERMS, _idf, term_counts
from dossier.session import cut_lineage, written
from dossier.sources.index import NO_DIRECTION, ChunkIndex, term_part

# Bounds are compared with this slack, which is above the rounding of sums and below that of scores.
SLACK = 1e-8
# The first look stops once its levels hold this many times the places of the list.
FIRST_LOOK = 4
# Rows of a pair of blocks: queries are copied for each block of a cell's vectors, vectors for each block of its queries.
QUERY_ROWS, VECTOR_ROWS = 1 << 16, 1 << 16


def _passes(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    for f in filters:
        rows = rows.where(F.col(f"_q_{f}").isNull() | (F.col(f"_q_{f}") == F.col(f)))
    return rows


def _floor(scored: DataFrame, score: str, n: int, ties: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """``query_id, floor``: the n-th best score of each query that has so many."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *ties)
    best = scored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    return best.groupBy("query_id").agg(F.min(score).alias("floor"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")


def term_levels(queries: DataFrame, index: ChunkIndex, filters: Sequence[str] = ()) -> tuple[DataFrame, list[int]]:
    """Levels of each query's terms with weights and bounds, and the parts of the index that hold them."""
    queries = queries.select("query_id", "text", *[F.nullif(F.col(f), F.lit("")).alias(f"_q_{f}") for f in filters])
    flags = [f"_q_{f}" for f in filters]
    terms = term_counts(queries, "query_id", "text", flags).withColumn("part", term_part("term"))
    terms = cut_lineage(terms)
    parts = sorted(r["part"] for r in terms.select("part").distinct().collect())
    total = index.stats()["n"]
    found = index.levels().where(F.col("part").isin(*parts)).join(terms.withColumnRenamed("tf", "qtf"), ["part", "term"])
    weight = F.col("qtf") * _idf(F.lit(total), F.col("df"))
    of_term = Window.partitionBy("query_id", "term")
    rows = found.select("query_id", *flags, "part", "term", "level", "n", weight.alias("q_weight"), (weight * F.col("top")).alias("bound"))
    return cut_lineage(rows.withColumn("term_bound", F.max("bound").over(of_term))), parts


def needed_levels(levels: DataFrame, floor: DataFrame) -> DataFrame:
    """Levels that can hold a chunk of the list, with ``maker``: whether their term makes candidates.

    ``others``: what all other terms can add; ``rest``: what the terms that make no candidate can add together.
    """
    terms = levels.select("query_id", "term", "term_bound").distinct()
    rising = Window.partitionBy("query_id").orderBy("term_bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    of_query = Window.partitionBy("query_id")
    known = terms.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))) - SLACK)
    known = known.select("*", F.sum("term_bound").over(rising).alias("upto"), F.sum("term_bound").over(of_query).alias("all"))
    known = known.withColumn("maker", F.col("upto") >= F.col("floor"))
    known = known.withColumn("rest", F.sum(F.when(F.col("maker"), 0.0).otherwise(F.col("term_bound"))).over(of_query))
    known = known.select("query_id", "term", "floor", "maker", "rest", (F.col("all") - F.col("term_bound")).alias("others"))
    return levels.join(known, ["query_id", "term"]).where(F.col("bound") + F.col("others") >= F.col("floor"))


def sparse_topk_stored(queries: DataFrame, index: ChunkIndex, n: int, *, filters: Sequence[str] = ()) -> DataFrame:
    """``(query_id, chunk_id, sparse_score, sparse_rank)``, the rows of ``sparse_topk`` over the indexed chunks.

    ``queries``: query_id, text and the filter columns, which must be payload of the index; a null or
    empty filter is absent. A query without a known term has no rows.
    """
    levels, parts = term_levels(queries, index, filters)
    flags = [f"_q_{f}" for f in filters]
    stats, postings, keys = index.stats(), index.postings(parts), ["part", "term", "level"]
    asked = written(levels.select("query_id", *flags).distinct(), "asked")
    once = not stats["repeated"]

    def added(levels: DataFrame, deal: int) -> DataFrame:
        """``query_id, block, place, score`` over the lists of these levels, which travel to the tasks with their queries."""
        lists = postings.join(F.broadcast(levels.select(*keys).distinct()), keys, "left_semi").repartition(deal, "block")
        met = lists.join(F.broadcast(levels.select("query_id", *keys, "q_weight")), keys)
        met = met.select("query_id", "block", "q_weight", "weights", F.posexplode("places").alias("_i", "place"))
        met = met.groupBy("query_id", "block", "place").agg(F.sum(F.col("q_weight") * F.get("weights", F.col("_i"))).alias("score"))
        met = met.join(F.broadcast(levels.select("query_id", "floor").distinct()), "query_id").where(F.col("score") >= F.col("floor")).drop("floor")
        if not filters:
            return met
        # A block's members are one row beside the task's pairs, which lie there by block already.
        member = lambda f: F.get("members", F.col("place"))[f].alias(f)
        held = met.join(index.blocks().select("block", "members").hint("shuffle_hash"), "block").select(*met.columns, *[member(f) for f in filters])
        return _passes(held.join(F.broadcast(asked.join(levels.select("query_id").distinct(), "query_id", "left_semi")), "query_id"), filters).select(*met.columns)

    def first(met: DataFrame) -> DataFrame:
        """A block's first ``n`` of each query, in its own task; places are in the order of ids. An id of several rows needs all of its scores."""
        order = Window.partitionBy("query_id", "block").orderBy(F.round("score", SCORE_DIGITS).desc(), "place")
        return met.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn") if once else met

    def every(levels: DataFrame, deal: int, name: str) -> DataFrame:
        blocks = max(1, -(-levels.count() // QUERY_TERMS))
        of_block = lambda i: levels.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else levels
        return written(reduce(DataFrame.unionByName, [first(added(of_block(i), deal)) for i in range(blocks)]), name)

    falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    looked = levels.withColumn("_before", F.coalesce(F.sum("n").over(falling), F.lit(0))).where(F.col("_before") < FIRST_LOOK * n)
    looked = written(looked.select("query_id", *keys, "q_weight", F.lit(float("-inf")).alias("floor")), "first-look")
    width = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An id of several rows adds up their scores, which no level bounds: such an index is searched without a floor.
    floor = _floor(every(looked, width, "looked"), "score", n, ["block", "place"]).where(F.lit(once))
    kept = written(needed_levels(levels, floor).select("query_id", *keys, "q_weight", "floor"), "levels")

    near = every(kept, max(width, -(-stats["n"] * asked.count() // PAIRS)), "near")
    if once:
        near = near.join(_floor(near, "score", n, []), "query_id", "left").where(F.col("score") >= F.coalesce("floor", F.lit(float("-inf"))) - SLACK)
        near = written(near.drop("floor"), "nearest")
    found = near.join(index.blocks().select("block", F.inline("members")), ["block", "place"])
    scored = found.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), SCORE_DIGITS).alias("sparse_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sparse_score"), F.asc("chunk_id"))
    return scored.withColumn("sparse_rank", F.row_number().over(order)).where(F.col("sparse_rank") <= n)


def cell_bounds(queries: DataFrame, index: ChunkIndex) -> DataFrame:
    """``query_id, cell, n, bound`` of every cell; the centres (at most ``CELLS`` vectors) travel to the tasks."""
    cells = sorted(index.cells().collect(), key=lambda r: r["cell"])
    known = [r for r in cells if r["cell"] != NO_DIRECTION]
    ids, sizes = np.array([r["cell"] for r in cells], np.int32), np.array([r["n"] for r in cells], np.int64)
    centres, radius = np.array([r["centre"] for r in known]), np.array([r["radius"] for r in known])
    open_ = len(cells) - len(known)
    id_type = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit_rows(batch.column(1))
            bound = np.ones((len(unit), len(cells)))
            if len(known):
                angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
                bound[:, open_:] = np.cos(np.maximum(angle - radius, 0))
            row = np.repeat(np.arange(len(unit)), len(cells))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.tile(ids, len(unit))), pa.array(np.tile(sizes, len(unit))), pa.array(bound.ravel())],
                names=["query_id", "cell", "n", "bound"],
            )

    return queries.select("query_id", "embedding").mapInArrow(run, f"query_id {id_type}, cell int, n long, bound double")


def _score_cells(visits: DataFrame, queries: DataFrame, vectors: DataFrame, n: int, filters: Sequence[str], skip_same_id: bool) -> DataFrame:
    """Best ``n`` chunks of each visited cell for each of its queries.

    Both sides of a cell are dealt into blocks, and each pair of blocks is one group, so a large
    cell or a cell that many queries visit is many tasks of bounded size.
    """
    wide = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("q_blocks"), F.ceil(F.max("n") / VECTOR_ROWS).cast("int").alias("v_blocks"))
    wide = cut_lineage(wide)
    deal = lambda key, blocks: F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = visits.select("query_id", "cell").join(wide, "cell").join(queries.select("query_id", "embedding", *filters), "query_id")
    left = left.select("query_id", "embedding", *filters, "cell", deal("query_id", "q_blocks").alias("qb"), every("v_blocks").alias("vb"))
    right = vectors.select("chunk_id", "vector", *filters, "cell").join(wide, "cell")
    right = right.select("chunk_id", "vector", *filters, "cell", deal("chunk_id", "v_blocks").alias("vb"), every("q_blocks").alias("qb"))
    types = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        qs, best = _queries_as_arrays(asked, "query_id", "embedding", filters), _Best(n)
        kinds = [_plain(asked.schema.field("query_id").type), _plain(held.schema.field("chunk_id").type), pa.float64()]
        if asked.num_rows:
            for low in range(0, held.num_rows, CHUNK_BATCH):
                part = held.slice(low, CHUNK_BATCH)
                codes = [_codes(part.column(f), k, _UNKNOWN) for f, k in zip(filters, qs["known"], strict=True)]
                _fold(best, qs, _keys(part.column("chunk_id")), _unit_rows(part.column("vector")), codes, n, skip_same_id)
        return pa.Table.from_batches([_result(best, qs, ["query_id", "chunk_id", "dense_score"], kinds)])

    keys = ["cell", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {types[0]}, chunk_id {types[1]}, dense_score double")


def dense_topk_stored(queries: DataFrame, index: ChunkIndex, n: int, *, filters: Sequence[str] = (), skip_same_id: bool = False) -> DataFrame:
    """``(query_id, chunk_id, dense_score, dense_rank)``, the rows of ``dense_topk`` over the indexed chunks.

    ``queries``: query_id, embedding and the filter columns, which must be payload of the index.
    Queries stay in Spark; one whose vector is null, of another width, or has null components finds nothing.
    """
    vectors = index.vectors()
    width = max((len(r["centre"]) for r in index.cells().select("centre").collect()), default=0)
    whole = (F.size("embedding") == (width or F.size("embedding"))) & ~F.exists("embedding", lambda x: x.isNull())
    asked = cut_lineage(queries.select("query_id", "embedding", *filters).where(F.col("embedding").isNotNull() & whole))
    bounds = cell_bounds(asked, index)
    falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    visits = cut_lineage(bounds.withColumn("first", F.coalesce(F.sum("n").over(falling), F.lit(0)) < n + skip_same_id))
    found = cut_lineage(_score_cells(visits.where("first"), asked, vectors, n, filters, skip_same_id))
    floor = _floor(found, "dense_score", n)
    open_ = visits.where("NOT first").join(floor, "query_id", "left").where(F.coalesce(F.col("bound") >= F.col("floor") - SLACK, F.lit(True)))
    more = _score_cells(cut_lineage(open_.select("query_id", "cell", "n")), asked, vectors, n, filters, skip_same_id)
    order = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), F.asc("chunk_id"))
    return found.unionByName(more).withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= n)
