"""Ids given to several texts, repeated rows, and buckets that hold many classes."""

import random

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import near_dedup


def text(rng, n=60):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def near(words):
    return [*words[:30], "changed", *words[31:]]


def test_two_texts_under_one_id_are_both_searched_and_neither_is_lost(spark):
    rng = random.Random(1)
    p, q = text(rng), text(rng)
    rows = [(1, p), (1, q), (2, near(q)), (3, near(p)), (4, text(rng)), (4, None), (1, p)]
    docs = spark.createDataFrame([(i, " ".join(w) if w else None) for i, w in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.classes(docs).collect())
    assert got == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]
    left = sorted((r["doc_id"], r["text"] or "") for r in near_dedup.keep_one(docs).collect())
    assert left == sorted([(1, " ".join(p)), (1, " ".join(q)), (4, docs.where("doc_id = 4 AND text IS NOT NULL").first()["text"]), (4, "")])


def test_shared_counts_equal_set_intersections():
    rng = np.random.default_rng(4)
    sets = [rng.choice(200, size=rng.integers(0, 60), replace=False).astype(np.uint64) for _ in range(30)]
    classes = rng.integers(0, 6, 30)
    left, right = np.arange(0, 12), np.arange(12, 30)
    got = near_dedup._shared_counts([sets[i] for i in left], [sets[j] for j in right], classes[left], classes[right])
    for x, i in enumerate(left):
        for y, j in enumerate(right):
            if classes[i] != classes[j]:
                assert got[x, y] == len(np.intersect1d(sets[i], sets[j]))


def test_many_classes_in_one_bucket_dealt_into_blocks(spark, monkeypatch):
    """All members share a bucket; pairs of near copies lie in and across blocks, by members or by shingles."""
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = text(rng, rng.randrange(40, 90))
        texts += [words, near(words), words[:25] + text(rng, 40)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    members = docs.select(F.lit(7).cast("long").alias("key"), "doc_id", F.col("doc_id").alias("class"))
    grams = [near_dedup.labelled(" ".join(w)) for w in texts]
    wanted = {(i, j) for j in range(len(texts)) for i in range(j) if near_dedup.near(grams[i], grams[j])}
    for crowd, many in ((1000, 1 << 20), (25, 1 << 20), (1000, 2000)):
        monkeypatch.setattr(near_dedup, "CROWD", crowd)
        monkeypatch.setattr(near_dedup, "GRAMS", many)
        assert {tuple(sorted((r["a"], r["b"]))) for r in near_dedup._rest(members, docs).collect()} == wanted
    assert len(wanted) > 40
