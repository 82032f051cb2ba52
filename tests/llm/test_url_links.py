"""Links with dot segments and tags with quoted marks, against the standard library and SQL."""

from __future__ import annotations

import random
from urllib.parse import urljoin

import duckdb

from dossier.llm import oracles, url_filters

RULES = (("allow", "com/"), ("block", "net/es/"), ("block", "net/fr/"))


def test_dot_segments_as_in_the_standard(spark):
    rng = random.Random(4)
    hrefs = ["..", ".", "../", "./", "/..", "/../a", "../../../../x", "a/./b/../c?d=../e", "/a//../b", "...", "a/..b/.c"]
    hrefs += ["/".join(rng.choice(["a", "b", ".", "..", "c.d"]) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    rows = [(f"http://h.net{base}", href) for base in ("/", "/fr/x/a", "/fr/x/", "/q?r=/s/../t") for href in hrefs]
    pages = spark.createDataFrame([(u, f'<link rel="canonical" href="{h}">') for u, h in rows], "url string, html string")
    got = sorted((r["from_url"], r["to_url"]) for r in url_filters.alias_edges(pages).collect())
    assert got == sorted((u, urljoin(u, h)) for u, h in rows)


def test_blocks_reach_aliases_by_dots_and_past_quoted_marks(spark, tmp_path):
    tag = '<link rel="canonical" title="a>b" href="{}">'
    rows = [
        (1, "http://a.net/fr/b", "<p>none</p>"), (2, "http://a.net/x/y", tag.format("/es/../fr/b")), (3, "http://b.org/z", tag.format("http://a.net/./x/y")),
        (4, "http://c.org/z", "<link title='x>y' rel='canonical' href='http://a.net/es/q'>"), (5, "http://d.org/", "<link rel=canonical href=../k>"),
        (6, "http://e.org/", "<meta content=it's><link rel=\"canonical\" href=\"http://a.net/fr/\">"), (7, "http://f.org/", "<link " + "a=b " * 200000), (8, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(list(RULES), "verdict string, rule string")
    out = url_filters.judge_urls(pages, rules, url_filters.alias_edges(pages)).select("page_id", "verdict").collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow"}
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    sql = con.sql(f"SELECT page_id, verdict FROM ({oracles.url_filters(RULES)})").fetchall()
    assert sorted(sql) == sorted((r["page_id"], r["verdict"]) for r in out)
