import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from dossier.operators.chunking import chunk_table, fixed_chunks, structural_chunks
from dossier.queries import queries


def assert_cut(text, chunks, size):
    """Chunks fit, are not blank, and hold every visible character of the text in order."""
    assert all(len(c) <= size and c.strip() for c in chunks)
    at, body = 0, "".join(text.split())
    for chunk in chunks:
        piece = "".join(chunk.split())
        found = body.rfind(piece, 0, at + len(piece))
        assert found >= 0
        at = max(at, found + len(piece))
    assert at == len(body)


def cut(spark, texts, size, overlap):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows.select("id", structural_chunks("text", size, overlap).alias("c")).collect()
    return [r.c for r in sorted(got)]


@pytest.mark.parametrize("text,size,overlap,want", [
    ("abc", 10, 3, ["abc"]),
    ("   ", 10, 3, []),
    ("aaaa bbbb cccc", 10, 3, ["aaaa bbbb", "bbb cccc"]),
    ("abcdefghijkl", 5, 2, ["abcde", "defgh", "ghijk", "jkl"]),
])
def test_hand_traced(spark, text, size, overlap, want):
    assert cut(spark, [text], size, overlap) == [want]


def test_marker_kept_and_no_repeat(spark):
    (chunks,) = cut(spark, ["\nĐiều 1 aaa\nĐiều 2 bbb"], 10, 3)
    assert "".join(chunks).count("Điều") == 2
    assert chunks.count("aaa") == 1


PIECE = st.sampled_from(["a", "bb", "ccc ", "dddd. ", "\n", "\n\n", "\nĐiều ", "\nKhoản ", " ", "é", "xxxxxxxxxxxxxxxx"])


@settings(max_examples=12, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.lists(PIECE, max_size=40).map("".join), min_size=1, max_size=20),
       st.integers(4, 30), st.integers(0, 3))
def test_properties(spark, texts, size, overlap):
    for text, chunks in zip(texts, cut(spark, texts, size, overlap), strict=True):
        assert_cut(text, chunks, size)
        assert len(text) > size or chunks == ([text] if text.strip() else [])


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in queries()["chunk_structural"](spark, sf_dir).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert set(got) == {k for k, t in texts.items() if t.strip()}
    for k, chunks in got.items():
        assert_cut(texts[k], chunks, 1000)


def test_ids_are_stable(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    first = chunk_table(docs, fixed_chunks("text", 4, 1)).collect()
    again = chunk_table(docs.repartition(3), fixed_chunks("text", 4, 1)).collect()
    assert sorted(first) == sorted(again)
    assert len({r.chunk_id for r in first}) == len(first) == 4


@pytest.mark.parametrize("size,overlap", [(5, 5), (5, 6), (0, 0), (5, -1)])
def test_bad_arguments(size, overlap):
    with pytest.raises(ValueError):
        structural_chunks("x", size, overlap)
