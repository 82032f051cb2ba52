import datetime as dt
import json

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier.functions.similarity import trigram_codes, trigram_similarity
from dossier.operators import metadata as M


def over(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"id int, v {kind}")
    return [r.x for r in sorted(rows.select("id", make(F.col("v")).alias("x")).collect(), key=lambda r: r.id)]


def test_dates(spark):
    day = dt.date(2024, 3, 5)
    good = ["2024-03-05", "2024-3-5", "5/3/2024", "05-03-2024", "ngày 5/3/2024"]
    assert over(spark, good, fn.normalise_date) == [day] * len(good)
    assert over(spark, ["31/02/2024", "None", "", None, "2024-13-05"], fn.normalise_date) == [None] * 5


def test_type_from_number(spark):
    types = M.doc_types(spark)
    numbers = ["215/KH-UBND", "57-NQ/TW", "12/CV", "10/2020/NĐ-CP", "3/TTr-SKHCN"]
    rows = spark.createDataFrame([(n, None, None) for n in numbers], "doc_no string, doc_type string, type_code string")
    got = {r.doc_no: (r.doc_type, r.type_code) for r in M.resolve_type(rows, types).collect()}
    assert got == {
        "215/KH-UBND": ("ke_hoach", "KH"), "57-NQ/TW": ("nghi_quyet", "NQ"), "12/CV": ("cong_van", "CV"),
        "10/2020/NĐ-CP": ("khac", ""), "3/TTr-SKHCN": ("to_trinh", "TTr"),
    }


def test_replies(spark):
    replies = [
        '{"a": 1}', '```json\n{"a": 1}\n```', 'Here: {"a": 1} done', '[{"a": 1}, {"a": 2}]', '["text"]',
        "not json", None, '{"a": 1', "[]",
    ]
    got = over(spark, replies, lambda c: fn.parse_reply(c, "a bigint"))
    assert [r and r.a for r in got] == [1, 1, 1, 1, None, None, None, None, None]
    text = over(spark, replies, fn.reply_object_text)
    assert text[4] == "{}" and text[5] is None and text[6] is None
    assert json.loads(text[3]) == {"a": 1}


def test_white_space_as_in_python(spark):
    values = [" \t a b  \n", "\x1c x \x1f", "", "　", "a"]
    assert over(spark, values, fn.strip) == [v.strip() for v in values]
    assert over(spark, values, fn.is_blank) == [not v.strip() for v in values]


def test_names(spark):
    assert over(spark, ['a/b:c*"d"', " x? "], fn.safe_name) == ["a_b_c__d_", "x_"]
    assert over(spark, ["0_Report.PDF", "12_a.b.docx", "note.docx", "plain", "x_1.doc"], fn.twin_key) == [
        "report", "a.b", "note", "plain", "x_1"]
    assert over(spark, ["a.PDF", ".hidden", "b", "c.tar.gz"], fn.file_extension) == ["pdf", "", "", "gz"]
    assert over(spark, ["pdf", "csv", "docx", "png"], fn.file_kind) == ["pdf", "sheet", "word", "other"]


def test_tail_and_excerpt(spark):
    assert over(spark, ["abcdef"], lambda c: fn.tail(c, 0)) == [""]
    assert over(spark, ["abcdef"], lambda c: fn.tail(c, 10)) == ["abcdef"]
    assert over(spark, ["abcdef"], lambda c: fn.excerpt(c, 2, 3)) == [("ab", "def")]
    assert over(spark, ["a  b\n c"], lambda c: fn.probe(c, 3)) == ["a b"]


def test_lists(spark):
    values = [[" a ", "", None, "b", "c", "d", "e", "f", "g", "h"], None]
    assert over(spark, values, M.clean_topics, "array<string>") == [["a", "b", "c", "d", "e", "f"], []]
    assert over(spark, [["cds", "x", "bcvt", None]], M.clean_fields, "array<string>") == [["cds", "bcvt"]]
    assert over(spark, ["giao_nhiem_vu", "x", None], M.clean_role) == ["giao_nhiem_vu", "khac", "khac"]


def test_value_locks(spark):
    rows = spark.createDataFrame(
        [
            (1, "A", "2024-03-05", "s", "i", "", "5/3/2023", None, ""),
            (2, "A", "x", "s", "i", None, "1/2", "N/A", "o"),
            (3, None, None, None, None, None, None, None, None),
            (4, "", "bad", "", "i", "N/A", "as given", "t", None),
        ],
        "id int, doc_no string, issued_on string, subject string, issuer string,"
        " side_doc_no string, side_issued_on string, side_subject string, side_issuer string",
    )
    got = {r.id: (r.doc_no, r.issued_on, r.subject, r.issuer) for r in M.lock_values(rows).collect()}
    assert got == {
        1: ("", "2023-03-05", "s", "i"),
        2: ("A", None, "N/A", "o"),
        3: (None, None, None, None),
        4: ("N/A", "as given", "t", "i"),
    }


@settings(max_examples=20, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.text(max_size=20), st.text(max_size=20))
def test_similarity_is_symmetric(spark, a, b):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    s = trigram_similarity(fn.trigrams("a"), fn.trigrams("b"))
    r = trigram_similarity(trigram_codes("b"), trigram_codes("a"))
    x, y, same = rows.select(s, r, trigram_similarity(fn.trigrams("a"), fn.trigrams("a"))).first()
    assert x == y and 0 <= x <= 1 and same in (0.0, 1.0)


def test_trigrams_of_a_word(spark):
    assert over(spark, ["A", "cat-a"], fn.trigrams) == [["  a", " a "], ["  c", " ca", "cat", "at ", "  a", " a "]]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = rows.select(fn.cosine("a", "b"), fn.cosine("a", "z")).first()
    assert got[0] == pytest.approx(2 ** -0.5) and got[1] == 0.0
