"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import (
    chunk_dedup,
    embedding_dedup,
    fingerprints,
    language_id,
    licenses,
    mixing,
    near_dedup,
    packing,
    quality,
    url_filters,
)
from dossier.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} of{i}" for i in range(30_000))
PASSAGE = "the committee met on tuesday and agreed that the budget for the coming year should be spent on roads and bridges before anything else " * 2

ROWS = [
    (1, PASSAGE + "first tail of words", "en", "a", 10), (2, PASSAGE + "first tail of words", "en", "a", 10),
    (2, PASSAGE + "first tail of words", "en", "a", 10), (3, None, None, None, None), (4, "", "en", None, 0),
    (None, "a row without an id", "en", "b", 19), (5, LONG, "en", "b", len(LONG)), (6, "?!", None, "a", 2),
    (7, "ein kurzer Satz über Häuser", "de", "c", 27), (8, "Ein kurzer Satz über Häuser!", "de", "c", 28),
    (9, " \t\n", "en", "c", 3), (10, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit("clash") for n in (
        "rep", "key", "runs", "score", "lang_pred", "part", "stats", "size", "start", "block", "node", "length", "rank", "component", "_first",
    )})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (5, None, None), (None, 1, 0), (7, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")


def test_near_dedup(docs, none):
    got = sorted(near_dedup.classes(docs).collect(), key=str)
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["class_id"] == 1 and not by_id[2]["kept"]
    assert by_id[8]["class_id"] == 7  # equal but for case and marks
    assert by_id[4]["class_id"] == 3  # null counts as empty
    assert by_id[6]["class_id"] == 6 and by_id[9]["class_id"] == 9  # texts without words keep to themselves
    assert by_id[None]["class_id"] is None and by_id[None]["kept"]
    assert near_dedup.classes(none).collect() == []


def test_keep_one(docs, spark):
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(x) for x in (1, 3, None, 5, 6, 7, 9, 10))
    twice = spark.createDataFrame([ROWS[0], ROWS[0]], SCHEMA)
    assert near_dedup.keep_one(twice).count() == 1


def test_url_filters(spark):
    pages = spark.createDataFrame(
        [
            (1, "HTTP://Www.Example.COM/en/x?q#f", None), (2, None, ""), (3, "no scheme", "<p>"), (4, "http://a.example.com/en/", "x"),
            (5, "http://plain.org/a", '<link href="http://a.example.com/en/" rel="canonical">'), (5, "http://plain.org/a", '<link rel=canonical href=/b>'),
            (6, "https://plain.org/b", "<META HTTP-EQUIV='refresh' CONTENT='0; URL=c?x=1&amp;y=2'>"), (7, "http://plain.org/c?x=1&y=2", None),
            (8, "http://good.com/z", '<link rel="canonical" href="//a.example.com/en/">'), (9, "http://net", None), (None, "http://x.net/es/1", None), (10, "://", None),
        ],
        "page_id long, url string, html string",
    ).withColumns({"rule": F.lit(1), "verdict": F.lit(2), "host": F.lit(3), "node": F.lit(4)})
    rules = spark.createDataFrame([*URL_RULES, ("block", None), ("allow", "x.net/es/2")], "verdict string, rule string")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"], r["decided_by"]) for r in url_filters.judge_urls(pages, rules, url_filters.alias_edges(pages)).collect())
    assert got == [
        (0, "x.net", "/es/1", "net/es/", "block", "rule"),
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow", "rule"), (2, "", "", None, "allow", "default"), (3, "", "", None, "allow", "default"),
        (4, "a.example.com", "/en/", "example.com/en/", "block", "rule"), (5, "plain.org", "/a", None, "block", "alias"), (5, "plain.org", "/a", None, "block", "alias"),
        (6, "plain.org", "/b", None, "block", "alias"), (7, "plain.org", "/c", None, "block", "alias"), (8, "good.com", "/z", "com/", "allow", "rule"),
        (9, "net", "", None, "allow", "default"), (10, "", "", None, "allow", "default"),
    ]
    empty = pages.limit(0)
    assert url_filters.judge_urls(empty, rules.limit(0), url_filters.alias_edges(empty)).count() == 0


def test_fingerprints(docs, none):
    got = fingerprints.compare_with_edits(docs).collect()
    assert len(got) == len(ROWS)
    prints = {r["doc_id"]: r for r in got}
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] and prints[3]["fingerprint"] == prints[4]["fingerprint"] == "0" * len(prints[4]["fingerprint"])
    assert prints[3]["n_chars"] == 0 and prints[5]["n_chars"] == len(LONG)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.compare_with_edits(none).collect() == []
    assert {r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()} == {r["fingerprint"] for r in got}


def test_quality(docs, none, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.classify(none, labels).collect() == []
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_licenses(spark, docs, none):
    texts = ["one\nlicensed under THE apache license version 2 0\nend", "All rights reserved.", None, "", "All rights", "Licensed under CC BY-NC 4.0.\r\nAll rights reserved."]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("dice", F.lit("x"))).collect()
    assert [(r["license"], r["n_matches"], r["licenses"]) for r in sorted(got)] == [
        ("Apache-2.0", 2, ["Apache-2.0"]), ("Proprietary", 1, ["Proprietary"]), (None, 0, []), (None, 0, []), (None, 0, []),
        ("CC-BY-NC-4.0", 3, ["CC-BY-NC-4.0", "Proprietary"]),
    ]
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).collect() == []
    assert licenses.scan(docs, templates=()).where("license IS NOT NULL").count() == 0


def test_licence_lines_and_published_texts(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
        "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
        "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    )
    apache = (
        "Copyright 2021 The Example Authors\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
        "You may obtain a copy of the License at"
    )
    bsd = next(t for name, t in licenses.TEXTS if name == "BSD-2-Clause")
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    body = next(t for name, t in licenses.TEXTS if name == "Apache-2.0" and len(t) > 5000)
    lines = [
        ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("All rights reserved.", "Proprietary"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        (mit, "MIT"), (apache, "Apache-2.0"), (lesser, "LGPL-2.1"),
    ]
    rows = [(i, f"some text before it\n\n{t}\n\nand more after it", name) for i, (t, name) in enumerate(lines)]
    rows += [(100, f"Copyright (c) 2019 Some One. {bsd}", "BSD-2-Clause"), (101, body, "Apache-2.0")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert got == {i: want for i, _, want in rows}


def test_packing(docs, none):
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    assert [(r["length"], r["start"]) for r in got if r["doc_id"] in (3, 4)] == [(1, 0), (1, 0)]
    long = sorted((r for r in got if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert len(long) > 50 and {r["length"] for r in long[1:]} == {1024} and long[0]["length"] <= 1024
    assert packing.pack_documents(none, tokenizer_path()).collect() == []


def test_chunk_dedup(docs, none):
    out = chunk_dedup.strip_repeats(docs)
    assert out.count() == len(ROWS)
    texts = {r["doc_id"]: r for r in out.collect()}
    assert "first tail" in texts[1]["text"] and len(texts[2]["text"]) < len(texts[1]["text"])  # the copy is emptied, repeats inside a text go too
    assert texts[3]["text"] is None and texts[4]["text"] == "" and texts[5]["text"] == LONG and texts[None]["text"] == "a row without an id"
    assert texts[2]["n_chars"] == len(texts[2]["text"]) and texts[5]["n_chars"] == len(LONG)
    assert chunk_dedup.strip_repeats(none).collect() == []


def test_mixing(docs, none):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["taken"] for r in got if r["size"] == 0} == {0} and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_counts(none).collect() == [] and mixing.mix_documents(none).collect() == []
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and all(r["n_chars"] == len(r["text"]) > 0 for r in mixed.collect())


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.15], 1), (14, [1.0, 0.32], 1), (15, [-1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"cell": F.lit(1), "v": F.lit(2), "w": F.lit(3), "id": F.lit(4)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_classes(frame).collect()}
    assert len(got) == len(rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False)
    assert got[13] == (4, 1, False) and got[14] == (1, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 15))
    assert embedding_dedup.link_classes(frame.limit(0)).collect() == []


def test_language(docs, none):
    profiles = language_id.learn_profiles(docs)
    assert sorted(profiles) == ["de", "en"]
    got = language_id.identify(docs, profiles, ["doc_id", "rep"]).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 6, 9, 8)} == {3: "und", 4: "und", 6: "und", 9: "und", 8: "de"}
    kept = language_id.keep_identified(docs, profiles)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 5, 7, 8, 10}
    assert language_id.learn_profiles(none) == {} and language_id.identify(none, {}, ["doc_id"]).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_stages(spark, docs, none):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns, name
        assert [f.dataType for f in at.schema] == [f.dataType for f in docs.schema], name
    assert corpus_pipeline.STAGES[-1][1](spark, at, "").count() > 50
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
