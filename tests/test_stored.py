"""Searches over the stored index equal the full searches and read less."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators.dense import dense_topk
from dossier.operators.sparse import sparse_topk
from dossier.operators.stored import _floor, cell_bounds, dense_topk_stored, needed_levels, sparse_topk_stored, term_levels
from dossier.plans.search import candidates, candidates_stored
from dossier.sources.index import CELLS, PARTS, ChunkIndex

SCHEMA = "chunk_id long, text string, embedding array<double>, doc_type string, issued int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    """A stop word in every chunk, rare words in few; clustered vectors, some null, zero or ties."""
    rng, gen = random.Random(5), np.random.default_rng(5)
    centres = gen.normal(size=(12, 16)) * 4
    rows = []
    for i in range(1500):
        words = ["the"] * rng.randrange(1, 4) + [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(0, 30))]
        vector = (centres[i % 12] + gen.normal(size=16) * 0.3).tolist()
        if i % 97 == 0:
            vector = None if i % 2 else [0.0] * 16
        rows.append((i, " ".join(words) if i % 101 else None, vector if i % 50 else rows[i - 1][2] if i else vector, rng.choice(["a", "b", "c", None]), i % 7))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def asked(chunks):
    other = F.when(F.col("chunk_id") % 3 == 0, F.lit("a")).when(F.col("chunk_id") % 3 == 1, F.lit(""))
    return chunks.where("chunk_id % 60 = 1 OR chunk_id IN (0, 97, 101)").select(F.col("chunk_id").alias("query_id"), "text", "embedding", other.alias("doc_type"))


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    return ChunkIndex(spark, str(tmp_path_factory.mktemp("index"))).write(chunks, payload=["doc_type", "issued"], cells=20)


@pytest.mark.parametrize("filters", [[], ["doc_type"]])
@pytest.mark.parametrize("n", [1, 7, 200])
def test_lexical_rows_are_those_of_a_full_search(asked, chunks, index, filters, n):
    full = sparse_topk(asked, chunks, n, filters=filters)
    assert sorted(sparse_topk_stored(asked, index, n, filters=filters).collect()) == sorted(full.collect())


@pytest.mark.parametrize("filters", [[], ["doc_type"]])
@pytest.mark.parametrize(("n", "skip"), [(1, True), (7, False), (400, True)])
def test_dense_rows_are_those_of_a_full_search(asked, chunks, index, filters, n, skip):
    full = dense_topk(asked, chunks, n, filters=filters, skip_same_id=skip)
    assert sorted(dense_topk_stored(asked, index, n, filters=filters, skip_same_id=skip).collect()) == sorted(full.collect())


def test_fused_rows_are_those_of_a_full_search(asked, chunks, index):
    assert sorted(candidates_stored(asked, index, 12, ["doc_type"]).collect()) == sorted(candidates(asked, chunks, 12, ["doc_type"]).collect())


def test_levels_and_cells_out_of_reach_are_not_read(spark, asked, index):
    short = spark.createDataFrame([(i, f"the w{i}") for i in range(1, 9)], "query_id long, text string")
    levels, parts = term_levels(short, index)
    full = needed_levels(levels, levels.select("query_id", F.lit(float("-inf")).alias("floor")).distinct()).count()
    scored = sparse_topk_stored(short, index, 3)
    floor = _floor(scored, "sparse_score", 3)
    kept = needed_levels(levels, floor)
    assert levels.count() == full and kept.count() < 0.7 * full
    # The stop word makes no candidates, so it never joins all chunks with all queries.
    assert kept.where("maker AND term = 'the'").join(floor, "query_id").count() == 0
    whole = asked.where("embedding IS NOT NULL")
    near = dense_topk_stored(whole, index, 5)
    reach = cell_bounds(whole, index).join(near.groupBy("query_id").agg(F.min("dense_score").alias("floor")), "query_id")
    assert reach.where("bound >= floor").count() < 0.6 * reach.count()


def test_only_the_terms_partitions_are_read_and_no_text_is_cut(spark, index):
    query = spark.createDataFrame([(1, "the w1", None)], "query_id long, text string, doc_type string")
    levels, parts = term_levels(query, index)
    assert 1 <= len(parts) <= 2 < PARTS
    text = plan(index.postings(parts))
    assert "PartitionFilters: [" in text and "part#" in text.split("PartitionFilters: [")[1].split("]")[0]
    found = plan(sparse_topk_stored(query, index, 5, filters=["doc_type"]))
    assert "regexp_extract_all" not in found and "text#" not in found
    dense = plan(dense_topk_stored(query.withColumn("embedding", F.array(*[F.lit(float(i)) for i in range(16)])), index, 5))
    assert "FlatMapCoGroupsInArrow" in dense


def test_index_without_rows_and_queries_without_hits(spark, chunks, asked, index, tmp_path):
    none = ChunkIndex(spark, str(tmp_path / "none")).write(chunks.limit(0), payload=["doc_type"])
    assert sparse_topk_stored(asked, none, 5).count() == 0 and dense_topk_stored(asked, none, 5).count() == 0
    odd = spark.createDataFrame([(1, "nowhere"), (2, None), (3, "")], "query_id long, text string")
    assert sparse_topk_stored(odd, index, 5).count() == 0
    narrow = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [None] * 16)], "query_id long, embedding array<double>")
    assert dense_topk_stored(narrow, index, 5).count() == 0


def test_a_filter_on_payload_reads_few_row_groups(spark, chunks, tmp_path):
    """Chunks are clustered by payload: files whose range does not hold the value are skipped by their statistics."""
    import pyarrow.parquet as pq

    index = ChunkIndex(spark, str(tmp_path / "clustered")).write(chunks.where("doc_type IS NOT NULL"), payload=["doc_type", "issued"], vector=None)
    groups = []
    for path in (tmp_path / "clustered" / "chunks").glob("*.parquet"):
        meta = pq.read_metadata(path)
        for g in range(meta.num_row_groups):
            at = [c for c in range(meta.num_columns) if meta.schema.column(c).name == "doc_type"][0]
            stats = meta.row_group(g).column(at).statistics
            groups.append(stats.min <= "a" <= stats.max)
    assert 0 < sum(groups) <= len(groups) / 2
    assert "EqualTo(doc_type,a)" in plan(index.chunks().where("doc_type = 'a'"))


def test_cells_are_bounded(index):
    assert index.cells().count() <= CELLS + 1


def test_lists_hold_a_block_of_chunks_and_rows_of_one_id_are_added(spark, asked, chunks, tmp_path):
    """An occurrence is no row of its own; a repeated id, with other lengths and payload, gives the rows of a full search."""
    again = chunks.where("chunk_id < 40").select("chunk_id", F.concat("text", F.lit(" the w1 w2")).alias("text"), "embedding", F.lit("a").alias("doc_type"), "issued")
    twice = chunks.unionByName(again).unionByName(chunks.where("chunk_id < 9"))
    index = ChunkIndex(spark, str(tmp_path / "twice")).write(twice, payload=["doc_type"], vector=None)
    lists = index.postings()
    assert "chunk_id" not in lists.columns and "doc_type" not in lists.columns
    assert lists.where("term = 'the'").count() <= 64 < lists.where("term = 'the'").select(F.sum(F.size("places"))).first()[0]
    for filters in ([], ["doc_type"]):
        assert sorted(sparse_topk_stored(asked, index, 7, filters=filters).collect()) == sorted(sparse_topk(asked, twice, 7, filters=filters).collect())


@pytest.mark.parametrize("filters", [[], ["doc_type"]])
def test_a_block_passes_on_its_best_only_and_its_lists_are_made_in_one_task(spark, asked, chunks, tmp_path, monkeypatch, filters):
    """Several blocks give the rows of a full search, ties included, and no task writes all pairs of its chunks and the queries."""
    from dossier.operators import stored
    from dossier.sources import index as store

    monkeypatch.setattr(store, "BLOCK_ROWS", 256)
    counts, real = {}, stored.written
    monkeypatch.setattr(stored, "written", lambda df, name: counts.setdefault(name, real(df, name)))
    tied = chunks.where("chunk_id % 3 > 0").unionByName(chunks.where("chunk_id % 3 = 0").withColumn("text", F.lit("the w1 w2")))
    index = ChunkIndex(spark, str(tmp_path / "blocks")).write(tied, payload=filters, vector=None)
    lists, blocks = index.postings(), index.blocks().count()
    assert blocks == 6 and lists.groupBy("block", "term", "level").count().where("count > 1").count() == 0
    assert sorted(sparse_topk_stored(asked, index, 7, filters=filters).collect()) == sorted(sparse_topk(asked, tied, 7, filters=filters).collect())
    assert 0 < counts["near"].count() <= 7 * blocks * asked.count()
