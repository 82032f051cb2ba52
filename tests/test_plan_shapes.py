"""What the physical plans promise."""

import pytest

from dossier.queries import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["newest_100", "search_newest", "document_read", "top_tags", "fetch_budget"])
def test_limits_are_top_k(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan(queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["pick_main_file", "dedupe_first", "sparse_topk", "newest_candidates", "rrf", "fetch_plan"])
def test_per_group_cut_runs_before_the_exchange(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", sorted(set(queries()) - {"dense_topk"} - {
    "rrf", "hybrid_filtered", "rerank", "context", "sources", "draft_context", "narrow_semi", "ingest_stream", "ingest_batch",
    "dense_topk_stored", "hybrid_stored", "context_stored"}))
def test_no_python_in_the_plan_and_no_cross_join(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    for word in ("Python", "MapInArrow", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(queries()["filter_optional"](spark, sf_dir))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThanOrEqual(o_orderdate" in text
    scan = plan(queries()["stats_by_type"](spark, sf_dir))
    assert "ReadSchema: struct<source:string>" in scan


def test_sparse_counting_and_scoring_share_one_exchange(spark, sf_dir):
    df = queries()["sparse_topk"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in plan(df)
