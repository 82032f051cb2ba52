"""Batch substring search against ILIKE of every term on every row, and counts that add up over batches."""

import random
from itertools import chain

from pyspark.sql import functions as F

from dossier.operators import substrings
from dossier.operators.stats import partial_counts
from dossier.operators.substrings import match_terms, newest_per_term
from dossier.plans.ingest import ingest
from dossier.plans.statistics import corpus_stats, list_documents
from dossier.sources.store import Store


def test_terms_as_ilike_on_every_row(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcÀé %_x") for _ in range(n))
    docs = [(i, word(rng.randrange(0, 30)), rng.choice([None, "", word(5), "𝒳y" + word(3)]), "x") for i in range(300)] + [(7, None, None, "y"), (8, "ABCabc", "abc", "z")]
    terms = [(word(rng.randrange(0, 6)),) for _ in range(120)] + [("",), ("%",), ("_",), ("__",), (None,), ("ABC",), ("𝒳",), ("a%b_c",), ("nowhere",), ("a\\%b",), ("\\_",)]
    d = spark.createDataFrame(docs, "doc_id long, a string, b string, term string")
    t = spark.createDataFrame(terms, "term string")
    got = sorted(map(tuple, match_terms(d, t, ["a", "b"]).collect()))
    every = t.distinct().crossJoin(d.drop("term")).where("a ILIKE concat('%', term, '%') OR b ILIKE concat('%', term, '%')")
    want = sorted(map(tuple, every.select("term", "doc_id").distinct().collect()))
    assert got == want and len(want) > 500
    slashes = spark.createDataFrame([("\\a\\b",), ("\\\\",), ("c\\",)], "term string")
    odd = spark.createDataFrame([(1, "xABx"), (2, "a\\b"), (3, "bc%"), (4, "bc")], "doc_id long, a string")
    assert sorted(map(tuple, match_terms(odd, slashes, ["a"]).collect())) == [("\\\\", 2), ("\\a\\b", 1), ("c\\", 3)]
    assert match_terms(d.limit(0), t, ["a", "b"]).count() == 0 and match_terms(d, t.limit(0), ["a"]).count() == 0


def test_a_rare_term_meets_few_rows(spark):
    rows = [(i, " ".join(f"common{i % 7}" for _ in range(20)) + (" zebra" if i % 100 == 0 else ""), i % 5) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, day int")
    terms = spark.createDataFrame([("common zeb",), ("ON6 ZEB",), ("zebra",)], "term string")
    out = newest_per_term(docs, terms, ["text"], date_column="day", limit=3, keep=["text"]).orderBy("term", "hit_rank").collect()
    assert [r["doc_id"] for r in out if r["term"] == "zebra"] == [0, 100, 200]
    plan = match_terms(docs, terms, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_long_text_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "é" * 1_000_000 + "needle")], "doc_id long, text string")
    terms = spark.createDataFrame([("needle",), ("éneed",), ("needles",)], "term string")
    assert sorted(r["term"] for r in match_terms(docs, terms, ["text"]).collect()) == ["needle", "éneed"]


def test_counts_of_batches_equal_a_recount(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert corpus_stats(store).count() == 0
    batches = [[(f"p{b}{i}", f"text {b} {i % 5} " * 30, ["in", "out"][i % 2], f"{i}/KH-UBND") for i in range(20)] for b in range(3)]
    for b, rows in enumerate(batches):
        for _ in range(2):  # a replay replaces the counts of its batch
            ingest(spark.createDataFrame(rows, "path string, text string, direction string, side_doc_no string"), store, f"b{b}")
    got = {(r["dimension"], r["value"]): r["cnt"] for r in corpus_stats(store).collect()}
    docs = store.documents()
    assert got["documents", None] == docs.count() == 15 and got["chunks", None] == store.chunks().count()
    for column in ("doc_type", "direction"):
        assert {v: n for (c, v), n in got.items() if c == column} == {r[0]: r[1] for r in docs.where(F.col(column).isNotNull()).groupBy(column).count().collect()}
    plan = corpus_stats(store)._jdf.queryExecution().executedPlan().toString()
    assert "full_text" not in plan and "/documents" not in plan
    assert [r["doc_no"] for r in list_documents(store, "3/kh").collect()] == [r["doc_no"] for r in docs.where("doc_no ILIKE '%3/kh%'").orderBy("doc_id").collect()]


def test_topics_and_odd_rows(spark):
    rows = [("t", None, ["a", "b", None], 2), (None, "in", None, None), ("t", "in", [], 0), ("", "in", ["b"], 5)]
    docs = spark.createDataFrame(rows, "doc_type string, direction string, topics array<string>, n_chunks int")
    got = sorted(((r["dimension"], r["value"] or "", r["cnt"]) for r in partial_counts(docs).collect()))
    assert got == sorted(chain([("documents", "", 4), ("chunks", "", 7), ("doc_type", "t", 2), ("doc_type", "", 1), ("direction", "in", 3), ("topic", "a", 1), ("topic", "b", 2)]))
    assert partial_counts(docs.limit(0)).count() == 0


def _record(monkeypatch):
    """Rows of each table that a search writes."""
    seen, plain = {}, substrings.written

    def written(df, name):
        out = plain(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(substrings, "written", written)
    return seen


def test_a_value_of_many_rows_is_searched_once(spark, monkeypatch):
    """Ten times the rows of the same values: the tables of n-grams and candidates stay as they are."""
    seen = _record(monkeypatch)
    terms = spark.createDataFrame([("lue ri",), ("b_ue",), ("zzz",)], "term string")
    for copies in (10, 100):
        docs = spark.range(copies * 3).select(F.col("id").alias("doc_id"), F.element_at(F.array(F.lit("blue ring"), F.lit("hot bolt"), F.lit("Blue")), (F.col("id") % 3 + 1).cast("int")).alias("text"))
        assert match_terms(docs, terms, ["text"]).count() == copies * 3
    assert all(small == large for small, large in seen.values()) and set(seen) >= {"held-grams", "found"}


def test_newest_of_each_term_as_by_brute_force(spark, monkeypatch):
    """Frequent and rare terms, wildcards, white space inside, undated rows, rows of one id; hits are cut before they are gathered."""
    seen, rng = _record(monkeypatch), random.Random(4)
    word = lambda: "".join(rng.choice("abcÀé") for _ in range(rng.randrange(1, 5)))
    text = lambda: rng.choice([" ", "\n", "\t"]).join(word() for _ in range(rng.randrange(0, 12)))
    rows = [(i // 2 if i < 20 else i, text(), rng.choice([None, text()]), rng.choice([None, 1, 2, 3])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string, day int")
    terms = [t for t in {word() for _ in range(60)} | {"a b", "b\nc", "a%c", "_", "", "AB", "nowhere"}]
    out = newest_per_term(docs, spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string"), ["a", "b"], date_column="day", limit=3, keep=["a"]).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["term"], r["hit_rank"])):
        got.setdefault(r["term"], []).append((r["doc_id"], r["day"]))
    for t in terms:
        every = docs.withColumn("t", F.lit(t)).where("a ILIKE concat('%', t, '%') OR b ILIKE concat('%', t, '%')").orderBy(F.desc_nulls_last("day"), "doc_id").limit(3)
        assert got.get(t, []) == [(r["doc_id"], r["day"]) for r in every.collect()], t
    assert seen["newest-of-words"][0] <= 3 * seen["vocabulary"][0]
