"""Repeats in texts without white space, and time that grows in line with a text's length."""

from __future__ import annotations

import random
import time

from dossier.llm import chunk_dedup


def test_shifted_passage_without_white_space(spark):
    rng = random.Random(3)
    chinese = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    pairs = []
    for _ in range(12):
        passage = chinese(400)
        pairs.append((passage, chinese(rng.randrange(1, 300)) + passage + chinese(100), chinese(rng.randrange(1, 300)) + passage + chinese(100)))
    rows = [(2 * i + k, p[k + 1]) for i, p in enumerate(pairs) for k in (0, 1)]
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (passage, first, second) in enumerate(pairs):
        assert got[2 * i] == first
        assert len(second) - len(got[2 * i + 1]) > 0.8 * len(passage)
        assert second.replace(passage, "") != second and got[2 * i + 1].startswith(second[: second.index(passage)])


def test_a_long_text_of_many_runs_in_linear_time(spark):
    rng = random.Random(5)
    passages = [" ".join(f"p{i}x{rng.randrange(10**6)}" for _ in range(30)) for i in range(500)]
    filler = lambda n: " ".join(f"u{rng.randrange(10**12)}" for _ in range(n))

    def strip(n):
        text = " ".join(rng.choice(passages) + " " + filler(12) for _ in range(n))
        frame = spark.createDataFrame([(0, " ".join(passages)), (1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        out = {r["doc_id"]: r["text"] for r in chunk_dedup.strip_repeats(frame).collect()}
        assert len(out[1]) < 0.7 * len(text)
        return time.perf_counter() - begun

    strip(100)
    short, long = strip(1500), strip(12000)
    assert long < 10 * short + 5


def test_passages_of_51_words_go_to_their_true_ends(spark):
    rng = random.Random(11)
    words = lambda n: [rng.choice("bcdfghlmnprst") + rng.choice("aeiou") * rng.randrange(1, 3) + rng.choice("lmnrst") + rng.choice(["", "er", "ing"]) + str(rng.randrange(30)) for _ in range(n)]
    passages = [" ".join(words(51)) for _ in range(200)]
    rows, want = [], {}
    for i, passage in enumerate(passages):
        for k in range(3):
            before, after = (" ".join(words(rng.randrange(5, 120))) for _ in range(2))
            rows.append((3 * i + k, f"{before} {i}{k}\n{passage}\n{k} {after}"))
            want[3 * i + k] = before, after, passage
    rows += [(1000 + i, " ".join(words(200)) + " " + " ".join(passages[i].split()[:12]) + " " + " ".join(words(50))) for i in range(50)]
    out = {r["doc_id"]: r for r in chunk_dedup.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = 0
    for doc_id, text in rows[:600]:
        if doc_id % 3 == 0:
            assert out[doc_id]["text"] == text
            continue
        gone += out[doc_id]["text"] != text
        if out[doc_id]["text"] != text:
            before, after, passage = want[doc_id]
            removed = len(text) - len(out[doc_id]["text"])
            assert len(passage) <= removed <= len(passage) + 8 and out[doc_id]["text"].startswith(before) and out[doc_id]["text"].endswith(after)
            assert [doc_id - doc_id % 3 <= r["first_doc_id"] < doc_id for r in out[doc_id]["runs"]] == [True]
    assert gone >= 398
    assert all(out[doc_id]["text"] == text for doc_id, text in rows[600:])
