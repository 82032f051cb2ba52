import datetime as dt
import json

from pyspark.sql import functions as F

from dossier.operators.chunking import integrity
from dossier.plans.ingest import ingest, rejected
from dossier.sources.store import Store
from dossier.streaming import ingest_landing

SCHEMA = "path string, native_text string, ocr_text string, reply string, direction string, side_doc_no string, side_issued_on string"


def batch(spark):
    body = "Kế hoạch năm. " * 200
    reply = "```json\n" + json.dumps({"doc_no": "1/X", "issued_on": "2024-01-02", "doc_type": "??", "fields": ["cds", "no"], "role": "x"}) + "\n```"
    rows = [
        ("d/a.pdf", body, None, reply, "out", "215/KH-UBND", "5/3/2024"),
        ("d/b.pdf", body, None, None, "in", None, None),  # a copy
        ("d/c.pdf", "short", "recognised text", None, "in", None, None),
        ("d/d.pdf", "", None, None, "in", None, None),  # no text at all
        ("d/e.pdf", "x\x00y" * 30, None, "no json", None, "9/BC-X", "N/A"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_batch_twice_and_replayed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.documents().count() == 0
    ingest(batch(spark), store, "1")
    docs = {r.file_name: r for r in store.documents().collect()}
    assert set(docs) == {"a.pdf", "c.pdf", "e.pdf"}
    a = docs["a.pdf"]
    # The number is locked to the sidecar's; the type was guessed from the extracted one before.
    assert (a.doc_no, a.issued_on, a.doc_type, a.type_code, a.fields, a.role) == (
        "215/KH-UBND", dt.date(2024, 3, 5), "khac", "", ["cds"], "khac")
    assert docs["c.pdf"].extract_method == "ocr_tesseract"
    assert docs["e.pdf"].full_text == "xy" * 30 and docs["e.pdf"].doc_type == "bao_cao"
    counts = {r.doc_id: r.n for r in store.chunks().groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {r.doc_id: r.n_chunks for r in docs.values()} and a.n_chunks > 1
    assert integrity(store.documents(), store.chunks()).count() == 0
    before = (store.documents().count(), store.chunks().count(), store.history().count())
    ingest(batch(spark), store, "2")  # the same rows as a new batch
    ingest(batch(spark), store, "1")  # the first batch replayed
    assert (store.documents().count(), store.chunks().count(), store.history().count()) == before
    assert {(r.direction, r.doc_no) for r in store.history().collect()} == {("out", "215/KH-UBND"), ("out", "9/BC-X")}
    assert [r.path for r in rejected(batch(spark)).collect()] == ["d/d.pdf"]


def test_stream_equals_batch(spark, tmp_path):
    rows = batch(spark)
    landing, check = str(tmp_path / "landing"), str(tmp_path / "check")
    rows.coalesce(1).write.parquet(landing)
    streamed, direct = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "d"))
    ingest_landing(spark, landing, streamed, check, rows.schema)
    rows.where("path > 'd/c'").union(rows.limit(1)).write.mode("append").parquet(landing)
    ingest_landing(spark, landing, streamed, check, rows.schema)
    ingest(rows, direct, "all")
    keep = ["sha256", "doc_no", "issued_on", "full_text", "n_chunks"]
    assert sorted(streamed.documents().select(keep).collect()) == sorted(direct.documents().select(keep).collect())
    ids = [sorted(r[0] for r in s.chunks().select("chunk_id").collect()) for s in (streamed, direct)]
    assert ids[0] == ids[1]


def texts(spark, names):
    return spark.createDataFrame([(f"d/{n}.txt", f"text of {n} " * 30, "out") for n in names], "path string, text string, direction string")


def test_two_streams_and_a_lost_checkpoint_lose_no_row(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = texts(spark, ["x"]).schema
    run = lambda folder, check: ingest_landing(spark, str(tmp_path / folder), store, str(tmp_path / check), schema)
    land = lambda folder, names: texts(spark, names).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
    held = lambda: sorted(r.file_name for r in store.documents().select("file_name").collect())
    land("a", ["1", "2"])
    land("b", ["2", "3"])
    run("a", "check_a")
    run("b", "check_b")
    assert held() == ["1.txt", "2.txt", "3.txt"]
    land("a", ["4"])
    run("a", "check_a")
    land("a", ["5"])
    run("a", "check_new")  # the checkpoint of the first stream is lost
    land("a", ["6"])
    run("a", "check_new")
    assert held() == [f"{i}.txt" for i in range(1, 7)]
    assert integrity(store.documents(), store.chunks()).count() == 0


def test_duplicate_test_reads_the_parts_of_the_batch_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(texts(spark, [str(i) for i in range(200)]), store, "first")
    one = texts(spark, ["7"]).withColumn("sha256", F.sha2(F.col("text"), 256))
    found = store.stored_hashes(one)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "/hashes" in text and "/documents" not in text
    assert "part#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert found.count() < 20 and store.hashes().count() == 200
    assert found.where(F.col("sha256") == store.documents().where("file_name = '7.txt'").first()["sha256"]).count() == 1


def test_replay_leaves_nothing_of_the_earlier_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    both = texts(spark, ["1", "2"]).withColumn("direction", F.when(F.col("path") == "d/1.txt", "in").otherwise("out"))
    ingest(both, store, "b")
    ingest(both.where("direction = 'in'"), store, "b")
    assert [r.direction for r in store.chunks().select("direction").distinct().collect()] == ["in"]
    assert store.hashes().count() == store.documents().count() == 1
    ingest(both, store, "c")
    assert store.documents().count() == 2


def test_one_row_of_equal_hash_and_path_is_chosen_the_same_way(spark, tmp_path):
    rows = [("p", "same text", f"{i}/KH-X") for i in range(20)]
    found = set()
    for n in (1, 7):
        batch = spark.createDataFrame(rows, "path string, text string, side_doc_no string").repartition(n)
        store = Store(spark, str(tmp_path / f"s{n}"))
        ingest(batch, store, "b")
        found |= {(r.doc_no) for r in store.documents().collect()}
    assert len(found) == 1


def test_rows_equal_in_hash_and_order_are_inserted_once(spark):
    from dossier.operators.dedupe import insert_status

    batch = spark.createDataFrame([("h", "p")] * 5 + [("g", "q")], "sha256 string, path string").repartition(3)
    got = insert_status(batch, batch.limit(0), "path").groupBy("sha256", "status").count().collect()
    assert {(r.sha256, r.status): r["count"] for r in got} == {("h", "inserted"): 1, ("h", "duplicate"): 4, ("g", "inserted"): 1}


def test_landing_files_grow_in_number_and_come_in_three_batches(spark, sf_dir, monkeypatch):
    from pathlib import Path

    from dossier.queries import selection

    paths, plain = {}, selection.scratch_path
    monkeypatch.setattr(selection, "scratch_path", lambda s, name: paths.setdefault(name, plain(s, name)))
    assert selection.q_ingest_stream(spark, sf_dir).count() > 0
    folder = lambda name: Path(paths[name].removeprefix("file:"))
    assert len(list(folder("landing").glob("*.parquet"))) > 3
    assert len(list(folder("store").glob("documents/batch_id=*"))) == 3
