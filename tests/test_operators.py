import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import content_hash
from dossier.operators import dedupe as D
from dossier.operators import figures as G
from dossier.operators import layout as L
from dossier.operators import selection as S
from dossier.operators import stats
from dossier.operators.assembly import assemble, choose_text
from dossier.operators.citations import citation_edges, extract_citations, resolve_citations
from dossier.operators.dense import dense_topk
from dossier.operators.fusion import rrf
from dossier.operators.fuzzy import fuzzy_topk
from dossier.operators.sparse import sparse_topk
from dossier.plans.layout import check_layout
from dossier.plans.selection import select_from_folder

FILE = "doc_no string, direction string, path string, name string, ext string, size long"


def files(spark, direction, names):
    rows = [("215/KH-UBND", direction, n, n, n.rsplit(".", 1)[-1], s) for n, s in names.items()]
    return spark.createDataFrame(rows, FILE)


@pytest.mark.parametrize("names,kept", [
    ({"215_signed.pdf": 5, "215_full.pdf": 9, "bang.xlsx": 1}, {"215_signed.pdf", "bang.xlsx"}),
    ({"can_cu_215.pdf": 9, "999.pdf": 8, "215.docx": 2, "b.doc": 3}, {"b.doc"}),
    ({"215_b.pdf": 4, "215_a.pdf": 4}, {"215_a.pdf"}),
])
def test_outgoing(spark, names, kept):
    got = S.select_attachments(files(spark, K.OUTGOING, names)).collect()
    assert {r.path for r in got} == kept


def test_incoming(spark):
    names = dict.fromkeys(["0_report.pdf", "1_report.docx", "note.docx", "phieu_gui.pdf", "x.csv", "scan.png"], 1)
    got = S.select_attachments(files(spark, K.INCOMING, names)).collect()
    assert {r.path for r in got} == {"0_report.pdf", "note.docx", "x.csv"}


def test_download_folder(spark, tmp_path):
    def put(name, record, body=b"x"):
        if body is not None:
            (tmp_path / name).write_bytes(body)
        text = record if isinstance(record, str) else json.dumps(record, indent=2)
        (tmp_path / (name + ".meta.json")).write_text(text, encoding="utf-8")

    put("215_a signed.pdf", {"so_ky_hieu": "215/KH", "huong": "di"})
    put("9_x.docx", {"so_ky_hieu": "9/BC", "huong": "den", "trich_yeu": "tờ"})
    put("none.pdf", {"trich_yeu": "no number"})
    put("gone.pdf", {"so_ky_hieu": "1"}, None)
    put("broken.pdf", "{not json")
    kept, rejects = select_from_folder(spark, str(tmp_path))
    got = {r.name: (r.doc_no, r.direction, r.size) for r in kept.collect()}
    assert got == {
        "215_a signed.pdf": ("215/KH", "out", 1), "9_x.docx": ("9/BC", "in", 1),
        "none.pdf": ("unknown_none.pdf.meta.json", "out", 1),
    }
    assert [r.sidecar_path.rsplit("/", 1)[-1] for r in rejects.collect()] == ["broken.pdf.meta.json"]


def test_fetch_budget(spark):
    listing = spark.createDataFrame(
        [("in", "1", "2024-01-09"), ("out", "2", "2024-01-01"), ("out", "2", "2024-01-03"), ("out", "3", "2024-01-02"),
         ("out", "", "2024-01-08"), ("in", "4", None)],
        "direction string, doc_no string, issued_on string",
    )
    history = spark.createDataFrame([("out", "3"), ("out", "1")], "direction string, doc_no string")
    rows = S.fetch_budget(listing, history).collect()
    assert [(r.direction, r.doc_no, r.issued_on) for r in rows] == [
        ("out", "2", "2024-01-03"), ("in", "1", "2024-01-09"), ("in", "4", None)]
    assert S.fetch_budget(listing, history, 1).count() == 1


def test_citations(spark):
    docs = spark.createDataFrame(
        [
            (1, "Căn cứ Nghị quyết số 57-NQ/TW ngày 22/12/2024;\ncăn CỨ Nghị định số 30/2020/NĐ-CP"),
            (2, "Căn cứ Luật Tổ chức chính quyền; căn cứ QĐ số 1/QĐ và số 2/QĐ"),
        ],
        "doc_id long, text string",
    )
    cites = extract_citations(docs)
    assert [(r.doc_id, r.pos, r.code) for r in cites.orderBy("doc_id", "pos").collect()] == [
        (1, 0, "57-NQ/TW"), (1, 1, "30/2020/NĐ-CP"), (2, 1, "1/QĐ")]
    narrow = extract_citations(docs, code=K.CITATION_CODE_NARROW).orderBy("doc_id", "pos").collect()
    assert [r.code for r in narrow][:2] == ["57-NQ", "30/2020"]
    corpus = spark.createDataFrame([(1, "57-NQ/TW"), (7, "57-NQ/TW"), (8, "30/2020/NĐ-CP")], "doc_id long, doc_no string")
    found = {r.code: [s.match_id for s in r.suggestions or []] for r in resolve_citations(cites, corpus).collect()}
    assert found["57-NQ/TW"] == [1, 7] and found["30/2020/NĐ-CP"][0] == 8
    edges = {(r.child_id, r.parent_code): r.parent_id for r in citation_edges(cites, corpus).collect()}
    assert edges[(1, "57-NQ/TW")] == 7  # never the document itself


def brute_top(probes, corpus, top, threshold=0.4):
    def grams(s):
        words = "".join(c if c.isalnum() else " " for c in s.lower()).split()
        return {f"  {w} "[i:i + 3] for w in words for i in range(len(w) + 1)}

    import numpy as np
    out = {}
    for p in set(probes):
        a = grams(p)
        scored = []
        for i, c in corpus:
            b = grams(c)
            s = len(a & b) / len(a | b) if a | b else 0.0
            if float(np.float32(s)) > threshold:
                scored.append((-s, i))
        out[p] = [i for _, i in sorted(scored)[:top]]
    return out


def test_fuzzy_against_all_pairs(spark):
    """Most numbers share their ending, and one number fills a third of the corpus."""
    corpus = [(i, f"{i * 7 % 140}/KH-UBND") for i in range(200)]
    corpus += [(1000 + i, "1/QĐ-UBND") for i in range(100)] + [(5000, ""), (5001, "--")]
    probes = [f"{i}/KH-UBND" for i in range(0, 160, 3)] + ["1/QĐ-UBND", "99-NQ/TW", "", "12/kh ubnd"]
    got = {}
    rows = fuzzy_topk(
        spark.createDataFrame([(p,) for p in probes * 3], "probe string"),
        spark.createDataFrame(corpus, "doc_id long, doc_no string"),
    ).collect()
    for r in sorted(rows, key=lambda r: r.match_rank):
        got.setdefault(r.probe, []).append(r.match_id)
    want = brute_top(probes, corpus, 3)
    assert got == {p: ids for p, ids in want.items() if ids}


def test_figures(spark):
    figures = spark.createDataFrame(
        [(q, d, f, v, None, "e") for q in ("s", "c") for d, f, v in
         [(1, True, "3"), (2, True, "4"), (3, True, None), (4, True, "abc"), (5, False, "9"), (6, True, "nan")]],
        "question_id string, doc_id long, found boolean, value string, unit string, evidence string",
    ).where("doc_id < 6")
    questions = spark.createDataFrame([("s", "sum"), ("c", "count"), ("e", None)], "question_id string, agg string")
    pairs = figures.select("question_id", "doc_id")
    got = {r.question_id: (r.total, r.n_docs_scanned, r.n_docs_matched) for r in G.totals(questions, pairs, figures).collect()}
    assert got == {"s": (7.0, 5, 3), "c": (4.0, 5, 4), "e": (0.0, 0, 0)}


def test_narrowing_guards(spark):
    pairs = spark.createDataFrame([("few", i) for i in range(5)] + [("many", i) for i in range(20)]
                                  + [("miss", i) for i in range(20)], "question_id string, doc_id long")
    hits = spark.createDataFrame([("few", 1), ("many", 3), ("many", 99), ("miss", 99)], "question_id string, doc_id long")
    got = {r[0]: r[1] for r in G.narrow(pairs, hits).groupBy("question_id").count().collect()}
    assert got == {"few": 5, "many": 1, "miss": 20}


def test_candidates_by_type_and_date(spark):
    docs = spark.createDataFrame(
        [(1, "a", dt.date(2024, 1, 1)), (2, "b", dt.date(2024, 2, 1)), (3, None, None)],
        "doc_id long, doc_type string, issued_on date",
    )
    q = spark.createDataFrame(
        [("all", None, None, None), ("a", "a", None, None), ("late", None, dt.date(2024, 1, 15), None)],
        "question_id string, doc_type string, date_from date, date_to date",
    )
    got = sorted((r.question_id, r.doc_id) for r in G.candidates(q, docs).collect())
    assert got == [("a", 1), ("all", 1), ("all", 2), ("all", 3), ("late", 2)]
    assert sorted((r.question_id, r.doc_id) for r in G.candidates(q, docs, 1).collect()) == [("a", 1), ("all", 2), ("late", 2)]


def layout_tables(spark, top=2.54, spacing=1.5, sizes=(14.5, 12.5, 13.5)):
    sections = spark.createDataFrame([(1, 0, top, 2.0, 3.0, 1.5), (1, 1, 9.0, 9.0, 9.0, 9.0), (2, 0, 2.0, 2.0, 3.0, 2.0)],
                                     "doc_id long, section int, top_cm double, bottom_cm double, left_cm double, right_cm double")
    paragraphs = spark.createDataFrame([(1, 1, "x", "child", spacing), (1, 2, "  ", "child", 9.0), (2, 1, "y", "Normal", None)],
                                       "doc_id long, para int, text string, style_id string, line_spacing double")
    runs = spark.createDataFrame([(1, 1, i, "t", None, s) for i, s in enumerate(sizes)] + [(1, 1, 9, " ", "Arial", 1.0), (2, 1, 0, "z", None, None)],
                                 "doc_id long, para int, run int, text string, font string, size_pt double")
    styles = spark.createDataFrame(
        [(1, "child", "mid", None, None), (1, "mid", "root", "", None), (1, "root", None, "Arial", 13.0),
         (1, "loop_a", "loop_b", None, None), (1, "loop_b", "loop_a", None, None), (2, "Normal", None, "Times New Roman", None)],
        "doc_id long, style_id string, base_style_id string, font string, size_pt double")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    return docs, sections, paragraphs, runs, styles


def test_layout(spark):
    issues, verdicts = check_layout(*layout_tables(spark))
    got = sorted((r.doc_id, r.kind, r.found, r.position) for r in issues.collect())
    assert got == [(1, "font", "Arial", "3 đoạn (vd đoạn [1, 1, 1])"), (1, "size", "12pt", "1 đoạn (vd đoạn [1])")]
    assert {r.doc_id: (r.n_issues, r.verdict) for r in verdicts.collect()} == {1: (2, L.FAIL_TEXT), 2: (0, L.PASS_TEXT)}


def test_layout_limits(spark):
    issues, _ = check_layout(*layout_tables(spark, top=2.56, spacing=1.6))
    got = {(r.kind, r.found, r.required) for r in issues.collect()}
    assert ("margin", "2.56cm", "2.0–2.5cm") in got and ("spacing", "1.6", "≤ 1.5") in got


def test_deep_style_chain(spark):
    n = 40
    rows = [(1, f"s{i}", f"s{i + 1}" if i < n - 1 else None, "F" if i == n - 1 else None, float(i) if i % 10 == 9 else None) for i in range(n)]
    styles = spark.createDataFrame(rows, "doc_id long, style_id string, base_style_id string, font string, size_pt double")
    got = {r.style_id: (r.font, r.size_pt) for r in L.style_closure(styles).collect()}
    assert got == {f"s{i}": ("F", float(i // 10 * 10 + 9)) for i in range(n)}


def test_assembly(spark):
    rows = [
        (1, 0, 0, 0, "page", "one"), (1, 1, 0, 0, "page", "two"),
        (2, 0, 1, 0, "paragraph", "p"), (2, 1, 0, 1, "cell", "b"), (2, 1, 0, 0, "cell", "a"), (2, 1, 1, 0, "cell", None),
        (2, 1, 1, 1, "cell", "d"), (3, 0, 0, 0, "sheet", "S"), (3, 0, 1, 0, "cell", "x"),
    ]
    got = dict(assemble(spark.createDataFrame(rows, "doc_id int, part int, row int, col int, kind string, text string")).collect())
    assert got == {1: "one\ntwo", 2: "p\na\tb\n\td", 3: "--- Sheet: S ---\nx"}


def test_text_choice(spark):
    rows = spark.createDataFrame([(1, " " + "x" * 50, "ocr"), (2, "x" * 49, " ocr "), (3, None, None)], "id int, native_text string, ocr_text string")
    got = {r.id: (r.extract_method, r.text) for r in choose_text(rows).collect()}
    assert got == {1: ("pdf_text", "x" * 50), 2: ("ocr_tesseract", "ocr"), 3: ("ocr_failed", None)}


def test_duplicates_with_one_hot_copy(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha256", content_hash("text"))
    assert D.first_per_content(docs, "doc_id").count() == 201
    status = D.insert_status(docs, docs.where("doc_id = 1"), "doc_id").groupBy("status").count().collect()
    assert dict(status) == {"inserted": 200, "duplicate": 100}


def test_dense_filters_and_tiles_agree(spark):
    rows = [(i, [float((i * 37) % 11), float(i % 5) - 2, 1.0], "ab"[i % 2]) for i in range(60)] + [(60, [0.0, 0.0, 0.0], "a")]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, direction string")
    queries = spark.createDataFrame([(i, r[1], None if i % 3 else "a") for i, r in enumerate(rows[:9])],
                                    "query_id long, embedding array<float>, direction string")
    one = dense_topk(queries, chunks, 5, filters=["direction"]).collect()
    two = dense_topk(queries, chunks.repartition(5), 5, filters=["direction"], block_bytes=64).collect()
    assert sorted(one) == sorted(two) and len(one) == 45
    side = dict((r[0], r[2]) for r in rows)
    assert all(side[r.chunk_id] == "a" for r in one if r.query_id % 3 == 0)


def test_dense_string_ids_and_no_queries(spark):
    chunks = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("é", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = [(r.query_id, r.chunk_id, r.dense_rank) for r in dense_topk(queries, chunks, 2).orderBy("dense_rank").collect()]
    assert got == [("q", "a", 1), ("q", "b", 2)]
    assert dense_topk(queries.where("query_id = 'none'"), chunks, 2).count() == 0


def test_rrf_falls_with_rank(spark):
    dense = spark.createDataFrame([(1, c, r) for r, c in enumerate("abc", 1)], "query_id int, chunk_id string, dense_rank int")
    sparse = spark.createDataFrame([(1, c, r) for r, c in enumerate("bd", 1)], "query_id int, chunk_id string, sparse_rank int")
    got = rrf(dense, sparse, 4).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "d", "c"]
    assert got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    assert all(x.rrf_score >= y.rrf_score for x, y in itertools.pairwise(got))


def test_listing_keeps_undated_last(spark):
    docs = spark.createDataFrame([(1, None, "CĂN"), (2, "2024", "căn"), (3, "2025", "x")], "id int, d string, t string")
    assert [r.id for r in stats.newest(docs, "d", "id").collect()] == [3, 2, 1]
    assert {r.id for r in stats.matching(docs, "Căn", ["t"]).collect()} == {1, 2}
    assert stats.matching(docs, "", ["t"]).count() == 3
    tags = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["a"],)], "tags array<string>")
    assert [tuple(r) for r in stats.top_tags(tags, "tags").collect()] == [("a", 2), ("b", 1)]
    assert docs.where(F.col("id") > 3).count() == 0


def test_fuzzy_on_codes_with_one_suffix(spark):
    codes = [(i, f"{i}/2020/QĐ-UBND") for i in range(400)]
    corpus = spark.createDataFrame(codes, "doc_id long, doc_no string")
    probes = spark.createDataFrame([(c,) for _, c in codes[::7]], "probe string")
    got = {}
    for r in fuzzy_topk(probes, corpus, skip_equal=True).collect():
        got.setdefault(r.probe, []).append((r.match_rank, r.match_id, round(r.similarity, 9)))
    sets = {c: {g for w in c.lower().replace("/", " ").replace("-", " ").split() for g in (("  " + w + " ")[i : i + 3] for i in range(len(w) + 1))} for _, c in codes}
    for _, code in codes[::7]:
        scored = sorted((-len(sets[code] & sets[c]) / len(sets[code] | sets[c]), i) for i, c in codes if c != code)
        assert sorted(got[code]) == [(k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(scored[:3])]


def test_insert_status_of_two_texts_on_one_path(spark):
    batch = spark.createDataFrame([("h1", "p"), ("h2", "p"), ("h2", "q")], "sha256 string, path string")
    got = sorted((r.sha256, r.path, r.status) for r in D.insert_status(batch, batch.limit(0), "path").collect())
    assert got == [("h1", "p", "inserted"), ("h2", "p", "inserted"), ("h2", "q", "duplicate")]


def test_empty_filter_is_absent_in_both_lists(spark):
    chunks = spark.createDataFrame([(1, "one two", [1.0, 0.0], "x"), (2, "two three", [0.0, 1.0], None)], "chunk_id long, text string, embedding array<float>, doc_type string")
    queries = spark.createDataFrame([(1, "two", [1.0, 1.0], ""), (2, "two", [1.0, 1.0], "x")], "query_id long, text string, embedding array<float>, doc_type string")
    dense = sorted((r.query_id, r.chunk_id) for r in dense_topk(queries, chunks, 5, filters=["doc_type"]).collect())
    sparse = sorted((r.query_id, r.chunk_id) for r in sparse_topk(queries, chunks, 5, filters=["doc_type"]).collect())
    assert dense == sparse == [(1, 1), (1, 2), (2, 1)]


def test_cut_and_narrowed_totals_are_reported(spark):
    docs = spark.createDataFrame([(i, None, "t") for i in range(80)], "doc_id long, issued_on date, doc_type string")
    questions = spark.createDataFrame([("all", ""), ("typed", "t"), ("none", "u")], "question_id string, doc_type string").selectExpr(
        "*", "CAST(NULL AS DATE) AS date_from", "CAST(NULL AS DATE) AS date_to", "'count' AS agg")
    pairs = G.candidates(questions, docs, 60)
    hits = spark.createDataFrame([("all", i) for i in range(5)], "question_id string, doc_id long")
    none = spark.createDataFrame([], "question_id string, doc_id long, found boolean, value string, unit string, evidence string")
    got = {r.question_id: (r.n_docs_scanned, r.truncated, r.narrowed) for r in G.totals(questions, G.narrow(pairs, hits), none).collect()}
    assert got == {"all": (5, True, True), "typed": (60, True, False), "none": (0, False, False)}
