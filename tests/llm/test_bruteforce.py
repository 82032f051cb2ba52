"""Every operator against a plain version of the same definition, a round trip, or held-out rows."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import chunk_dedup, embedding_dedup, fingerprints, mixing, near_dedup, oracles, packing, quality, url_filters
from dossier.llm.common import remainder, word_hashes
from dossier.llm.omh import label_occurrences, sketch
from dossier.llm.queries import QUERIES, URL_RULES, tokenizer_path


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]


def edit(rng, text, share):
    out = []
    for w in text:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(w if r > share * 2 / 3 else "new" + str(rng.randrange(10**6)))
        if r > 1 - share / 3:
            out.append("more" + str(rng.randrange(10**6)))
    return out


def labels_of(text, k=5):
    """Shingles with occurrence numbers."""
    seen, out = {}, []
    for i in range(max(1, len(text) - k + 1)):
        gram = tuple(text[i : i + k])
        seen[gram] = seen.get(gram, 0) + 1
        out.append((gram, seen[gram]))
    return out


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    kept = common_subsequence(a, b)
    return kept / (len(a) + len(b) - kept)


def spread(label, pairs):
    label = dict(label)
    again = True
    while again:
        again = False
        for a, b in pairs:
            low = min(label[a], label[b])
            again |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=25, unique=True), st.lists(st.integers(0, 30), max_size=25, unique=True), st.sampled_from([0.3, 0.5, 0.8]))
def test_banded_alignment(a, b, least):
    got = near_dedup.near(np.array(a, np.uint64), np.array(b, np.uint64), least)
    assert got == (bool(a or b) and alike(a, b) >= least - 1e-9)


def test_near_dedup(spark):
    rng = random.Random(5)
    texts = []
    for size in (3, 12, 60, 150, 400):
        for _ in range(6):
            base = words(rng, size)
            texts += [base, base[:], *(edit(rng, base, share) for share in (0.01, 0.02, 0.04))]
            texts.append(words(rng, size // 2) + base[: size // 2])
    rng.shuffle(texts)
    hot = words(rng, 120)
    texts += [edit(rng, hot, 0.02) for _ in range(150)]
    passage = words(rng, 40)
    texts += [words(rng, 60) + passage + words(rng, 30) for _ in range(80)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame).collect()}
    grams = [labels_of(t) for t in texts]
    sets = [set(g) for g in grams]
    near = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and alike(grams[j], grams[i]) >= 0.8:
                near.append((j, i))
    assert len(near) > 500
    assert got == spread({i: i for i in range(len(texts))}, near)


def test_crowded_bucket_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 16)
    rng = random.Random(8)
    passage = words(rng, 80)
    texts = [passage + words(rng, 45) for _ in range(60)]
    texts += [edit(rng, texts[i], 0.01) for i in (57, 58, 59)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # One bucket holds all, and neither text of a near pair is among the centres of the first rounds.
    reps = frame.select(F.col("doc_id").alias("rep"), F.array(F.lit(7).cast("long")).alias("keys"))
    got = {tuple(sorted((r["a"], r["b"]))) for r in near_dedup.links(reps, frame).collect()}
    grams = [labels_of(t) for t in texts]
    assert got == {(i, j) for j in range(len(texts)) for i in range(j) if alike(grams[i], grams[j]) >= 0.8} == {(57, 60), (58, 61), (59, 62)}


def test_order_matters_to_the_sketch():
    a = word_hashes("one two three four five six seven eight nine ten eleven twelve")
    assert (sketch(a, 64) == sketch(a[::-1].copy(), 64)).mean() < 0.1
    assert len(set(label_occurrences(np.array([7, 7, 7, 9], np.uint64)).tolist())) == 4
    rng = random.Random(2)
    t = words(rng, 600)
    near = [(sketch(word_hashes(" ".join(t)), 64) == sketch(word_hashes(" ".join(edit(rng, t, s))), 64)).mean() for s in (0.02, 0.1, 0.4)]
    assert near[0] > near[1] > near[2]


def test_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = [(r["doc_id"], r["text"] or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    got = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        changed = text[: len(text) - k] + other[:k]
        own, new, following = (fingerprints.signature(t) for t in (text, changed, other))
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == own.tobytes().hex() and r["edited_fingerprint"] == new.tobytes().hex()
        assert r["near_edited"] == np.mean(own == new) and r["near_next"] == np.mean(own == following)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.97


def test_url_aliases_as_sql(spark, tmp_path):
    rng = random.Random(3)
    hosts = ["a.example.com", "www.example.com", "b.example.net", "x.org", "y.org", "z.org"]
    paths = ["/en/1", "/es/2", "/fr/", "/a", "/a/b", "/", ""]
    urls = sorted({f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=1', '#t'])}" for _ in range(150)})
    tag = lambda u: rng.choice([
        f'<link rel="canonical" href="{u}">', f"<meta http-equiv=refresh content='0;url={u}'>", '<link rel="stylesheet" href="/x.css">', '<link rel="canonical" href="../up">',
    ])
    rows = [(i, u, "<html>" + (tag(rng.choice(urls)) if rng.random() < 0.3 else "") + "</html>") for i, u in enumerate(urls)] + [(999, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, rule string")
    got = spark_rows(url_filters.judge_urls(pages, rules, url_filters.alias_edges(pages)))
    assert got == sql_rows(con, oracles.url_filters(URL_RULES))
    assert any("alias" in row for row in got[1])


def test_quality(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = QUERIES["op4_quality"](spark, big).where("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.95


def test_discriminant():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = {0: rng.normal(0, 1, (300, d)), 1: rng.normal(0.5, 2, (500, d))}
    model = quality.Discriminant({c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in x.items()}, shrink=0.0, ridge=0.0)
    want = 0
    for c, sign in ((1, 1), (0, -1)):
        cov = np.cov(x[c].T, bias=True)
        diff = x[1][:20] - x[c].mean(axis=0)
        want = want + sign * (-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-(want + np.log(501 / 301))))
    assert np.allclose(model.score(x[1][:20]), want, atol=1e-6)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_packing"](spark, sf_dir).collect()
    place, lengths = {}, []
    for doc_id, text in docs.items():
        ids = [*exact.encode(text, add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        at = 0
        for i, r in enumerate(mine):
            assert (r["piece"], r["start"]) == (i, at) and (i == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
            place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            lengths.append(r["length"])
        assert at == len(ids)
    for parts in place.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((1024 if fit is None else fit) - n)
    assert len(place) == len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_sweep(counts):
    fill, rounds = {}, sorted(packing.sweep(counts, 40))
    for length, n in counts.items():
        for rank in range(n):
            row = [r for r in rounds if r[0] == length and r[1] <= rank][-1]
            nth = rank - row[1]
            fill.setdefault(row[3] + nth // row[2], []).append((row[4] + nth % row[2] * length, length))
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 40


def test_odd_texts_tokenise_as_the_library_does(spark):
    from tokenizers import Tokenizer

    exact, own = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    for text in ("a\x1cb \x1f c", "x\x85y", "it's we'LL  \n\n tabs\t\tend ", "<|endoftext|> plain <|endoftext|>", "ünïcödé 日本語 🙂👍🏽 ٣٤", "a​b 　c d", "  lead", "1234abc!!??"):
        assert np.frombuffer(own(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def test_very_long_white_space_tokenises_as_the_library_does():
    from tokenizers import Tokenizer

    exact, own = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    for text in ("a" + " " * 2_000_000 + "b", "a" + "\n" * 1_000_000 + "b", "a" + " \t" * 5_000 + "b", "a" + " " * 9_999 + "b"):
        assert np.frombuffer(own(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def plain_chunks(text):
    raw = text.encode()
    gear = chunk_dedup._GEAR.tolist()
    space = (32, 9, 10, 11, 12, 13)
    out, last, h = [], 0, 0
    for i, b in enumerate(raw):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        n = i + 1 - last
        whole = i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80
        unspaced = whole and h & (0b111 << 29) == 0 and not any(c in space for c in raw[max(0, i - 31) : i + 1])
        fits = unspaced or (b in space and h & chunk_dedup.MASK == 0)
        if n == 256 and i + 1 < len(raw) and not fits:
            end = i + 1
            while raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[last:end])
            last = end
        elif n >= 32 and fits:
            out.append(raw[last : i + 1])
            last = i + 1
    return [*out, raw[last:]] if last < len(raw) else out


def test_chunk_dedup(spark):
    rng = random.Random(9)
    passage = " ".join(words(rng, 60))
    texts = [" ".join(words(rng, rng.randrange(1, 300))) for _ in range(60)]
    texts = [t + "\n" + passage + "\n" + " ".join(words(rng, 50)) if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[1], "é" * 700, "日本 " * 200, texts[2] + " x"]
    for t in texts:
        ends = chunk_dedup.cuts(np.frombuffer(t.encode(), np.uint8))
        assert plain_chunks(t) == [t.encode()[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    first, want = {}, []
    for i, t in enumerate(texts):
        gone, at, run = bytearray(len(t)), 0, []
        for c in [*plain_chunks(t), None]:
            if c is not None and c in first:
                run.append((at, c, first[c]))
            elif run:
                (low, _, (a, x)), (high, c_last, (b, y)) = run[0], run[-1]
                high, y, run = high + len(c_last.decode()), y + len(c_last.decode()), []
                while low and x and t[low - 1] == texts[a][x - 1]:
                    low, x = low - 1, x - 1
                while high < len(t) and y < len(texts[b]) and t[high] == texts[b][y]:
                    high, y = high + 1, y + 1
                gone[low:high] = b"\1" * (high - low)
            if c is not None:
                first.setdefault(c, (i, at))
                at += len(c.decode())
        out, low = "", 0
        for flag, group in itertools.groupby(gone):
            piece = t[low : low + len(list(group))]
            low += len(piece)
            if not flag or (len(piece.split()) < 40 and len(piece.encode()) < 320):
                out += piece
        want.append(out)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.strip_repeats(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(passage in t for t in want) == 1
    assert all(got[i] == texts[i] for i in range(60) if i % 3)


def test_permutation_and_targets(spark):
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        out = mixing.with_permuted(spark.range(n), "p", F.col("id"), F.lit(n).cast("long"), F.lit(5)).select("p").toPandas()
        assert sorted(out.p) == list(range(n))
    rng = random.Random(1)
    sizes = [rng.choice([0, 5, 50, 500, 5000]) for _ in range(11)]
    frame = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(mixing.cycling_weights(frame)).orderBy("source").collect()]
    weights, open_, target = [(3.0, 1.0, 2.0)[i % 3] for i in range(11)], set(range(11)), {}
    while True:
        left = 1.5 * sum(sizes) - sum(target.values())
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 2 * sizes[i]]
        if not over:
            target.update(share)
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
            open_.remove(i)
    assert np.allclose(got, [target[i] for i in range(11)])


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op8_mixing"](spark, sf_dir).toPandas()
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert {r.doc_id: r["size"] for _, r in got.iterrows()} == size
    assert (got.taken <= 2 * got["size"]).all()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 3 * mixing.BLOCK).all()
    again = QUERIES["op8_mixing"](spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    mixed = mixing.mix_documents(docs).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).toPandas()
    assert dict(zip(mixed.doc_id, mixed.n, strict=True)) == {r.doc_id: r.taken for r in got.itertuples() if r.taken}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(scale=0.12, size=(500, 8)), rng.normal(size=(200, 8)), np.repeat(rng.normal(size=(1, 8)), 90, axis=0)])
    label = np.concatenate([rng.integers(0, 2, 700), np.zeros(90, int)])
    frame = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(6)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_classes(frame).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    component = spread({i: i for i in range(len(x))}, [tuple(map(int, p)) for p in np.argwhere(np.triu(near))])
    assert near.sum() > 8500
    assert got == {i: (int(near[i].sum()), component[i]) for i in range(len(x))}
    units = embedding_dedup.distinct_vectors(frame.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")))[1]
    parted = embedding_dedup.cells(units)
    assert parted.select("cell").distinct().count() > 4  # pivots were used
    assert parted.where("home").count() == units.count()


def test_language(spark, sf_dir):
    got = QUERIES["op10_language"](spark, sf_dir.replace("0.001", "0.01"))
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    right = got.where("held_out").join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_remainders(spark):
    frame = spark.createDataFrame([(i,) for i in (0, 7, 123456789, None)], "k long")
    assert [r[0] for r in frame.select(remainder("k", 5)).collect()] == [zlib.crc32(("" if k is None else str(k)).encode()) % 5 for k in (0, 7, 123456789, None)]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_runs_and_takes_effect(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    assert out.count() > 0
    if stage == 1:
        assert docs.count() > out.count() > 0.7 * docs.count()
