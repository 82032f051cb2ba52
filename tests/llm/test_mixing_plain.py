"""The mix against a plain walk over blocks, small sources, repeated rows, and the draw of shards."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dossier.llm import embedding_dedup, fingerprints, mixing

SCHEMA = "doc_id long, source string, text string"


def words(n: int, start: int = 0) -> str:
    return " ".join(f"w{start + i}" for i in range(n))


@pytest.mark.parametrize("n", [1, 10, 20, 64, 65, 200])
def test_a_small_source_meets_its_target(spark, n):
    docs = spark.createDataFrame([(1, "a", words(n)), (2, "b", words(5000))], SCHEMA)
    got = {r["doc_id"]: r for r in mixing.mix_counts(docs).collect()}
    assert got[1]["target"] == 2 * n == got[1]["taken"]
    assert abs(got[2]["taken"] - got[2]["target"]) <= 1


def test_the_mix_equals_a_plain_walk(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, words(3 + (i * 37) % 211, i)) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.make_plan(sizes)
    facts = {r["rank"]: r for r in plan.collect()}
    drawn = mixing.slots(plan, shard=16).collect()
    order = defaultdict(list)
    for r in mixing.layout(sizes, "doc_id").orderBy("start").collect():
        order[r["source"]] += [r["doc_id"]] * r["size"]

    taken, passes, filled = Counter(), defaultdict(list), Counter()
    for s in drawn:
        source = facts[s["rank"]]["source"]
        line = order[source][s["block"] * mixing.BLOCK : (s["block"] + 1) * mixing.BLOCK]
        assert 1 <= s["length"] <= len(line)
        taken.update(line[: s["length"]])
        passes[source, s["copy"]].append(s["block"])
        filled[source] += s["length"]
    assert filled == {f["source"]: f["wanted"] for f in facts.values()}
    assert all(abs(f["wanted"] - f["target"]) <= 0.5 for f in facts.values())
    for (source, copy), blocks in passes.items():
        n = -(-len(order[source]) // mixing.BLOCK)
        assert len(set(blocks)) == len(blocks) <= n
        if (source, copy + 1) in passes:
            assert set(blocks) == set(range(n))
    got = mixing.mix_counts(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == dict(taken)
    assert all((r["first_shard"] is None) == (r["taken"] == 0) for r in got)

    assert sorted(s["position"] for s in drawn) == list(range(len(drawn)))
    counts = mixing.shard_counts(plan, shard=16).collect()
    by_shard = Counter()
    for c in counts:
        by_shard[c["shard"]] += c["slots"]
    assert sorted(by_shard.values())[1:] == [16] * (len(by_shard) - 1)
    assert sum(c["words"] for c in counts) == sum(filled.values())


def test_shards_hold_sources_by_chance_as_drawn(spark):
    plan = spark.createDataFrame([(1, "a", 64 * 6000, 64 * 6000, 6000, 6000), (2, "b", 64 * 3000, 64 * 3000, 3000, 3000)], "rank int, source string, source_size long, wanted long, blocks long, slots long")
    assert mixing.slots(plan).rdd.getNumPartitions() > 1
    shares = [r["slots"] for r in mixing.shard_counts(plan, shard=300).where("source = 'a'").collect()]
    mean = sum(shares) / len(shares)
    spread = sum((s - mean) ** 2 for s in shares) / len(shares)
    assert len(shares) == 30 and mean == 200 and 15 < spread < 200  # 300 * 2/3 * 1/3 = 67 in a draw by chance


def test_repeated_rows_are_mixed_each(spark):
    rows = [(1, "a", words(70))] * 3 + [(None, "a", words(30))] * 2 + [(2, "b", words(400)), (None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = mixing.mix_counts(docs)
    mixed = mixing.mix_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    want = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    assert {r["source"]: r["n"] for r in mixed.collect()} == want and want["a"] > 140
    assert counts.count() == len(rows)


def test_vectors_of_repeated_and_null_ids(spark):
    rows = [
        (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, None, 1), (1, [1.0, 0.0], None), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1),
        (None, [0.01, 1.0], 1), (3, [0.02, 1.0], 1), (None, [5.0, 5.0], 1), (None, None, 1),
    ]
    out = embedding_dedup.link_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out)
    assert got == Counter({
        (1, 1, 1, True): 1, (2, 1, 1, False): 1, (1, 3, 1, True): 1, (3, 3, 1, False): 1, (None, 3, 1, False): 2,
        (1, 0, 1, True): 2, (None, 0, None, True): 2,
    })


def test_each_range_of_successors_is_a_task(spark):
    docs = spark.createDataFrame([(i, words(3, i)) for i in range(400)], "doc_id long, text string")
    parts = fingerprints.with_successors(docs).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("part").alias("n")).collect()
    assert len(parts) > 1 and all(r["n"] == 1 for r in parts)
