"""Line rules, tokenizer alignment and collocations: plain versions, planted cases and odd input."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dossier.llm import alignment, collocations, line_rules
from dossier.llm.packing import _BYTE_OF
from dossier.llm.queries import QUERIES, pieces_path, tokenizer_path

SCHEMA = "doc_id long, text string, lang string"
LONG = " ".join(f"word{i % 997} of{i}." for i in range(60_000))
ODD = [
    (None, None, None), (1, "", "en"), (1, "", "en"), (2, " \t\n", "en"), (3, "a▁b", None), (4, "<|endoftext|> x </s> <s>", "en"), (5, " lead", "und"),
    (6, "tab\tnew\n\nline  two\r\n", "en"), (7, "日本語😀 ﬁ. İx", "ja"), (8, "\x00\x1c\x85", "en"), (9, LONG, "en"), (9, LONG, "en"), (None, "no id", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in (
        "row", "lines", "words", "lost", "n_words", "kept", "a", "b", "n", "rest", "phrase", "score", "level", "w1", "short", "windows", "n_a",
    )})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_line_measures_of_odd_texts(odd):
    rows = line_rules.judged(odd).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert tuple(r)[2:7] == plain_measures(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert r["kept"] is not None and not (r["kept"] and r["base_failed"])


def test_repeated_windows_that_overlap(spark):
    texts = ["a a a a", "a b c a b c", "a b a b a b a", "x y z", "a b", "", None, "q a b c d e a b c r a b c"]
    rows = line_rules.judged(spark.createDataFrame([(t,) for t in texts], "text string")).select("row.text", "n_repeat_words").collect()
    assert {r["text"]: r["n_repeat_words"] for r in rows} == {t: plain_measures(t)[4] for t in texts}


def test_failed_lines_go_and_clean_documents_stay(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(string.ascii_lowercase) * rng.randrange(2, 9) + str(rng.randrange(10**6)) for _ in range(n)).capitalize() + "."
    good = [prose(30), prose(25), prose(40)]
    bad = ["Home | News | Sport | Contact.", "All rights reserved.", "heading without an end", "buy!! now!! only!! today!!", "a### b*** c$$$ d%%%."]
    docs = spark.createDataFrame(
        [(1, "\n".join(good)), (2, "\n".join([bad[0], good[0], bad[1], good[1], bad[2], bad[3], bad[4]])), (3, "\n".join(bad * 20)), (4, None)], "doc_id long, text string",
    )
    rows = {r["doc_id"]: r for r in line_rules.judged(docs).select("row.doc_id", "*").collect()}
    assert [rows[i]["kept"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert (rows[2]["n_lines"], rows[2]["n_failed_lines"]) == (7, 5)
    out = {r["doc_id"]: r["text"] for r in line_rules.keep_clean(docs).collect()}
    assert out == {1: "\n".join(good), 2: "\n".join(good[:2])}


def test_line_rules_keep_columns_of_an_empty_table(none, odd):
    assert line_rules.keep_clean(none).columns == none.columns and line_rules.keep_clean(none).count() == 0
    assert line_rules.keep_clean(odd).columns == odd.columns


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=pieces_path())
    a_model.encode_special_tokens = True
    a_bytes = {i: bytes(_BYTE_OF[c] for c in t) for t, i in a_model.get_vocab(with_added_tokens=False).items()}
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    counts, kept, out = Counter(), [], []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        sides = [[a_bytes[i] for i in a], [b_bytes(i) for i in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            kept.append([])
            out.append([doc_id, 0, 0, 0, 0, 0, 0, ""])
            continue
        ends = [[sum(map(len, s[: i + 1])) for i in range(len(s))] if len(s) < 500 else list(__import__("itertools").accumulate(map(len, s))) for s in sides]
        i = j = 0
        links, groups, own = [], [], ([a[0]], [b[0]])
        while True:
            links.append((a[i], b[j]))
            if ends[0][i] == ends[1][j]:
                groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                own = ([a[i]], [b[j]])
            elif ends[0][i] < ends[1][j]:
                i += 1
                own[0].append(a[i])
            else:
                j += 1
                own[1].append(b[j])
        counts.update(links)
        kept.append(links)
        out.append([doc_id, len(a), len(b), len(groups), len(links), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest()])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for row, links in zip(out, kept, strict=True):
        row[5] = sum(counts[p] == highest[p[1]] for p in links)
        row[6] = sum(counts[p] for p in links)
    return Counter(map(tuple, out))


@pytest.mark.parametrize("hot", [1, 300, 1 << 18])
def test_alignment_equals_a_walk_over_both_token_lists(spark, sf_dir, odd, hot):
    """With a small ``hot`` nearly all pairs are joined, with the default nearly all travel to the tasks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    found = alignment.align(docs, tokenizer_path(), pieces_path(), hot=hot)
    assert Counter(map(tuple, found.collect())) == plain_alignment([tuple(r) for r in docs.collect()])


def test_alignment_of_an_empty_table_and_clashing_columns(none, odd):
    assert alignment.align(none, tokenizer_path(), pieces_path()).count() == 0
    assert alignment.align(odd, tokenizer_path(), pieces_path()).count() == len(ODD)


def test_a_tokenizer_that_parts_texts_otherwise_runs_itself(tmp_path):
    import json

    spec = json.load(open(tokenizer_path()))
    spec["pre_tokenizer"]["use_regex"] = False
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    other, usual = alignment.ByteLevel(str(path)), alignment.ByteLevel(tokenizer_path())
    text = " it's 12 o'clock,  isn't it?"
    assert other.fast is None and usual.fast is not None
    assert other([text])[0] == other.tokenizer.encode(text, add_special_tokens=False).ids
    assert usual([text])[0] == usual.tokenizer.encode(text, add_special_tokens=False).ids


def plain_collocations(rows, limit):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, n in f.items():
        known = {p: a for p, a in n.items() if len(p) > 1 and a >= 10}
        gone = {q for p, a in known.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * n[q]}
        scored = []
        for p, a in known.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (n[p[:k]] * n[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize(("limit", "bits"), [(5, 1 << 15), (40, 1 << 20), (2000, 1 << 25)])
def test_collocations_equal_counting_everything(spark, odd, limit, bits):
    """Small limits need several rounds; few bits make hashes collide."""
    rng = random.Random(limit)
    names = [f"n{i}" for i in range(40)]
    texts = []
    for i in range(400):
        words = [rng.choice(names) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            words += rng.choice([["New", "york", "city"], ["hot", "dog"], ["Ärzte", "ohne", "grenzen"], ["as", "as", "as", "as"]])
            words.append(rng.choice(["", ",", "\t", ". ", "\x0c"]))
        texts.append((i, " ".join(words), rng.choice(["en", "en", "en", "de", None, "und"])))
    docs = spark.createDataFrame(texts, SCHEMA).union(odd.select("doc_id", "text", "lang"))
    found = sorted(tuple(r) for r in collocations.mine(docs, limit, bits).collect())
    assert found == plain_collocations([(r["text"], r["lang"]) for r in docs.collect()], limit)


def test_long_texts_are_cut_at_ends_of_pieces(monkeypatch):
    texts = [b"aa bb. cc dd, ee ff gg hh ii jj kk! ll", b"mm nn", b"oo pp " * 30]
    parts = [p for block in collocations._blocks(texts, 12) for p in block.split(b"\xff")]
    whole = [p for t in texts for p in t.replace(b",", b".").replace(b"!", b".").split(b".")]
    assert Counter(p.strip() for p in parts) == Counter(p.strip() for p in whole)


def test_collocations_of_an_empty_table_and_of_rare_phrases(none, spark):
    assert collocations.mine(none).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "one two three", "en")], SCHEMA)).count() == 0


def test_new_queries_return_every_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op11_line_rules", "op12_alignment"):
        assert QUERIES[name](spark, sf_dir).count() == n
