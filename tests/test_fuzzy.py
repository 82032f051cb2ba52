"""The fuzzy join against all pairs, and how its pairs grow."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.operators import fuzzy


def grams(text):
    words = [w for w in re.split(r"[^0-9a-zđ]+", (text or "").lower()) if w]
    return frozenset(("  " + w + " ")[i : i + 3] for w in words for i in range(len(w) + 1))


def brute(probes, corpus, threshold, top, skip_equal):
    out = {}
    for p in {x for x in probes if x is not None}:
        scored = []
        for i, c in corpus:
            a, b = grams(p), grams(c)
            if a and b and not (skip_equal and p == c) and len(a & b) / len(a | b) > threshold + 1e-9:
                scored.append((-len(a & b) / len(a | b), i))
        for rank, (s, i) in enumerate(sorted(scored)[:top], 1):
            out[(p, rank)] = (i, round(-s, 9))
    return out


@pytest.mark.parametrize(("threshold", "top", "skip"), [(0.41, 3, True), (0.41, 3, False), (0.75, 1, True), (0.23, 5, False)])
def test_all_pairs(spark, threshold, top, skip):
    """One ending for all, equal sets in other order, a hot text, ties, and texts without trigrams."""
    rng = random.Random(top)
    corpus = [(i, f"{rng.randrange(3000)}/2020/qđ-ubnd") for i in range(150)]
    corpus += [(200 + i, " ".join(rng.sample(["alpha", "beta", "gamma", "delta"], 3))) for i in range(40)]
    corpus += [(300 + i, "hot text") for i in range(60)] + [(400, ""), (401, None), (402, "--"), (403, "qđ 2020 17/ubnd")]
    probes = [c for _, c in corpus[::3]] + ["17/2020/qđ-ubnd", "hot text", "nothing like it", None, ""]
    rows = fuzzy.fuzzy_topk(
        spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame(corpus, "doc_id long, doc_no string"),
        threshold=threshold, top=top, skip_equal=skip,
    ).collect()
    assert {(r.probe, r.match_rank): (r.match_id, round(r.similarity, 9)) for r in rows} == brute(probes, corpus, threshold, top, skip)


def test_pairs_grow_with_the_table_and_not_with_its_square(spark):
    n = {}
    for scale in ("0.01", "0.1"):
        urls = spark.read.parquet(f"/root/testdata/sf{scale}/pages.parquet").select(F.col("url").alias("value"))
        _, left, _, right = fuzzy.trigram_tables(urls, urls)
        n[scale] = (left.count(), fuzzy.similar_sets(left, right, fuzzy.first_look(left, right, 3, True), 0.4).count())
    assert n["0.1"][0] == 10 * n["0.01"][0]
    assert n["0.1"][1] < 15 * n["0.01"][1]


def test_bitmaps_leave_out_pairs_that_cannot_share_enough_and_no_others(spark):
    urls = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("url").alias("value"))
    _, left, _, right = fuzzy.trigram_tables(urls, urls)
    a, b = left.select(*[F.col(c).alias(f"l_{c}") for c in ("node", "size", "grams", "bits")]), right.select("node", "size", "grams", "bits")
    shared = F.size(F.array_intersect("l_grams", "grams"))
    most = fuzzy.most_shared("l_bits", "bits", F.col("l_size"), F.col("size"))
    pairs = a.crossJoin(b).select(shared.alias("shared"), most.alias("most"), (F.col("l_size") + F.col("size")).alias("both"))
    assert pairs.where("shared > most").count() == 0
    far = pairs.where("shared < 0.3 * both").count()
    assert pairs.where("shared < 0.3 * both AND most < 0.4 * both").count() > 0.5 * far > 0


def test_a_second_look_leaves_few_pairs_to_compare_and_no_floor_above_a_match(spark):
    """Sets meet their near pairs only: few are compared that are not in the result, and none of the result is lost."""
    urls = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    _, left, _, right = fuzzy.trigram_tables(*[urls.select(F.col("url").alias("value"))] * 2)
    floors = fuzzy.second_look(left, right, fuzzy.first_look(left, right, 3, True), 0.4, 3, True).cache()
    near = fuzzy.near_pairs(fuzzy._probes(left, floors, 0.4), right, 0.4)
    assert near.columns == ["left_id", "right_id", "apart"]
    assert fuzzy.similar_sets(left, right, floors, 0.4).count() < 6 * left.count()
    assert near.select("left_id", "right_id").distinct().count() < 12 * left.count()
    third = fuzzy.fuzzy_topk(urls, urls, probe="url", key="url", corpus_id="page_id", skip_equal=True).where("match_rank = 3")
    both = floors.join(third, F.col("left_node") == F.col("url"))
    assert both.count() > 2000 and both.where("floor > similarity + 1e-9").count() == 0


def test_a_trigram_of_many_texts_is_dealt_into_several_keys(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "GRAM_ROWS", 16)
    test_all_pairs(spark, 0.41, 3, True)
