"""Lexical ranking: what is shuffled, and that blocks, odd rows and repeated ids give the same rows."""

import math
import re
from collections import Counter

import pytest

from dossier.operators import sparse
from dossier.operators.fusion import rerank


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    texts = [None, "", "--", "a b a", "The the cat", "cat dog b", "a b a", "dog dog dog É é"]
    chunks = [(i, texts[i % 8] if i % 8 < 3 else f"{texts[i % 8]} w{i % 11}") for i in range(80)] + [(80, "a b"), (80, "b c")]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string"), spark.createDataFrame(chunks, "chunk_id long, text string")


def brute(queries, chunks, n, k1=1.2, b=0.75):
    cut = lambda t: [w.lower() for w in re.findall(r"\w+", t or "")]
    known = [cut(t) for _, t in chunks if t is not None]
    avg, total = sum(map(len, known)) / len(known), len(chunks)
    tf = Counter((i, len(cut(t)), w) for i, t in chunks for w in cut(t))
    df, scores = Counter(w for _, _, w in tf), Counter()
    for q, text in queries:
        for w, qtf in Counter(cut(text)).items():
            for (i, dl, v), f in tf.items():
                if v == w:
                    scores[q, i] += qtf * math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avg))
    best = {}
    for (q, i), s in sorted(scores.items(), key=lambda x: (x[0][0], -round(x[1], 9), x[0][1])):
        best.setdefault(q, []).append((i, round(s, 7)))
    return {q: rows[:n] for q, rows in best.items()}


@pytest.mark.parametrize(("pairs", "terms"), [(1 << 19, 1 << 20), (7, 3)])
def test_rows_as_by_brute_force(tables, monkeypatch, pairs, terms):
    monkeypatch.setattr(sparse, "PAIRS", pairs)
    monkeypatch.setattr(sparse, "QUERY_TERMS", terms)
    got = {}
    for r in sorted(sparse.sparse_topk(*tables, 9).collect(), key=lambda r: (r["query_id"], r["sparse_rank"])):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["sparse_score"], 7)))
    assert got == brute(*[list(map(tuple, t.collect())) for t in tables], 9)


def test_counts_are_not_shuffled_by_term_however_large_the_tables(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(sparse.sparse_topk(*tables, 9))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The one sorted join is that of query terms with their frequencies.
    assert len(re.findall("BroadcastHashJoin", text)) >= 2 and "SortMergeJoin [term" in text
    assert all("tf" not in line for line in text.splitlines() if "hashpartitioning(term" in line and "qtf" not in line)


def test_the_pool_is_written_before_it_meets_the_texts(spark, tables):
    queries, chunks = tables
    pool = spark.createDataFrame([(3, 4, 1), (3, 5, 2), (5, 5, 1)], "query_id long, chunk_id long, fused_rank int")
    out = rerank(pool, queries, chunks, 2)
    assert "/pool-" in plan(out)
    assert sorted((r["query_id"], r["chunk_id"]) for r in out.collect()) == [(3, 4), (3, 5), (5, 5)]


def test_weights_of_lone_rows_are_not_shuffled_and_those_of_one_id_are_added(tables):
    _, chunks = tables
    out = sparse.sparse_weights(chunks)
    text = plan(out)
    assert not re.search(r"hashpartitioning\(chunk_id#\d+L?, dl#", text)
    got = {(r["chunk_id"], r["term"], round(r["weight"], 9)) for r in out.collect()}
    rows = list(map(tuple, chunks.collect()))
    cut = lambda t: [w.lower() for w in re.findall(r"\w+", t or "")]
    known = [cut(t) for _, t in rows if t is not None]
    avg, tf = sum(map(len, known)) / len(known), Counter((i, len(cut(t)), w) for i, t in rows for w in cut(t))
    df = Counter(w for _, _, w in tf)
    idf = lambda w: math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
    assert tf[80, 2, "b"] == 2
    assert got == {(i, w, round(idf(w) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg)), 9)) for (i, dl, w), f in tf.items()}


@pytest.mark.parametrize("terms", [1 << 20, 2])
def test_only_terms_asked_for_are_written_and_dealt(spark, tables, monkeypatch, terms):
    monkeypatch.setattr(sparse, "QUERY_TERMS", terms)
    kept, write = {}, sparse.written
    monkeypatch.setattr(sparse, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    queries = spark.createDataFrame([(1, "cat b"), (2, "b É none"), (3, None)], "query_id long, text string")
    got = {}
    for r in sorted(sparse.sparse_topk(queries, tables[1], 9).collect(), key=lambda r: (r["query_id"], r["sparse_rank"])):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["sparse_score"], 7)))
    assert got == brute(list(map(tuple, queries.collect())), list(map(tuple, tables[1].collect())), 9)
    rows = kept["counted"].select("chunk_id", "term").collect()
    # One row stands for each chunk, also of those without text, whose number and lengths count.
    assert sum(r["term"] == "" for r in rows) == tables[1].count()
    if terms > 2:
        assert {r["term"] for r in rows} == {"", "cat", "b", "é"}


def test_counts_are_dealt_once(tables):
    out = sparse.sparse_topk(*tables, 9)
    out.collect()
    assert len(set(re.findall(r"Exchange hashpartitioning\(chunk_id#\d+L?, \d+\), REPARTITION_BY_NUM, \[plan_id=\d+\]", plan(out).split("Initial Plan")[0]))) == 1
