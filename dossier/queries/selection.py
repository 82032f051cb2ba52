"""Attachments, fetch plan, duplicates and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import content_hash
from dossier.operators import dedupe as D
from dossier.operators import selection as S
from dossier.plans.ingest import ingest
from dossier.plans.selection import fetch_plan
from dossier.queries.tables import WINDOW_CHUNKS, spread, table, window_chunks
from dossier.queries.texts import sql_strip
from dossier.session import scratch_path
from dossier.sources.store import Store
from dossier.streaming import ingest_landing


def _files(spark, sf_dir):
    """Order lines as attachments of their order."""
    lines, orders = spread(spark, sf_dir, "lineitem", "l_orderkey"), table(spark, sf_dir, "orders")
    number = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).otherwise(F.col("l_partkey"))
    ext = F.element_at(
        F.array(*[F.lit(e) for e in ("pdf", "docx", "xlsx", "doc", "png")]),
        (F.col("l_suppkey") % 5 + 1).cast("int"),
    )
    name = F.concat(
        F.col("l_linenumber").cast("string"),
        F.lit("_"),
        F.when(F.col("l_returnflag") == "R", "can_cu_")
        .when(F.col("l_returnflag") == "A", "phieu_gui_").otherwise(""),
        number.cast("string"),
        F.when(F.col("l_linestatus") == "O", "_signed").otherwise(""),
        F.lit("."),
        ext,
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("/KH-UBND")).alias("doc_no"),
        F.when(F.col("o_orderstatus") == "F", K.OUTGOING).otherwise(K.INCOMING).alias("direction"),
        F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", name).alias("path"),
        name.alias("name"),
        ext.alias("ext"),
        F.col("l_quantity").cast("bigint").alias("size"),
    )


FILES = """
WITH named AS (
  SELECT *, l_linenumber || '_'
    || CASE l_returnflag WHEN 'R' THEN 'can_cu_' WHEN 'A' THEN 'phieu_gui_' ELSE '' END
    || CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE l_partkey END
    || CASE WHEN l_linestatus = 'O' THEN '_signed' ELSE '' END || '.'
    || ['pdf', 'docx', 'xlsx', 'doc', 'png'][CAST(l_suppkey % 5 + 1 AS INTEGER)] AS name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
files AS (
  SELECT l_orderkey || '/KH-UBND' AS doc_no, CAST(l_orderkey AS VARCHAR) AS number,
    CASE WHEN o_orderstatus = 'F' THEN 'out' ELSE 'in' END AS direction,
    l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || name AS path, name,
    regexp_extract(name, '[.]([a-z]+)$', 1) AS ext, CAST(l_quantity AS BIGINT) AS size
  FROM named),
ruled AS (
  SELECT *, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('xls', 'xlsx', 'csv') THEN 'sheet'
      WHEN ext IN ('doc', 'docx') THEN 'word' ELSE 'other' END AS kind,
    contains(name, 'signed') AS signed,
    CASE WHEN direction = 'out'
      THEN NOT (contains(name, 'can_cu') OR contains(name, 'cancu') OR contains(name, 'thamkhao'))
           AND (contains(name, 'signed') OR contains(name, number))
      ELSE NOT (contains(name, 'phieu_gui') OR contains(name, 'phieu_chuyen') OR contains(name, 'ticket')
                OR contains(name, 'luanchuyen')) END AS pdf_ok
  FROM files),
main_file AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY
        CASE WHEN kind = 'word' THEN 3 WHEN signed THEN 1 ELSE 2 END, size DESC, path) AS rn
    FROM ruled WHERE direction = 'out' AND (kind = 'word' OR (kind = 'pdf' AND pdf_ok)))
  WHERE rn = 1),
keyed AS (SELECT *, regexp_replace(regexp_replace(name, '[.][^.]*$', ''), '^[0-9]+_', '') AS base_name
          FROM ruled WHERE direction = 'in'),
no_twin AS (
  SELECT * FROM keyed w WHERE kind = 'word' AND NOT EXISTS (
    SELECT 1 FROM keyed p WHERE p.kind = 'pdf' AND p.pdf_ok AND p.doc_no = w.doc_no AND p.base_name = w.base_name))"""
FILE_COLUMNS = "doc_no, direction, path, name, ext, size, kind"


def q_pick_main_file(spark, sf_dir):
    return S.main_outgoing(S.with_rules(_files(spark, sf_dir))).select("doc_no", "path", "kind", "size")


def q_no_twin(spark, sf_dir):
    return S.without_twin(S.with_rules(_files(spark, sf_dir))).select("doc_no", "path", "kind")


def q_select_attachments(spark, sf_dir):
    return S.select_attachments(_files(spark, sf_dir))


def q_group_sizes(spark, sf_dir):
    return S.group_sizes(_files(spark, sf_dir))


def _event_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    number = F.concat_ws("/", F.col("user_id").cast("string"), F.regexp_extract("props", "[0-9]+", 0))
    rows = events.select(
        "event_type",
        F.when(F.col("event_type").isin("purchase", "error"), K.OUTGOING).otherwise(K.INCOMING).alias("direction"),
        number.alias("doc_no"), F.col("ts").alias("issued_on"), F.col("event_id").alias("subject"),
    )
    seen = rows.event_type.isin("error", "view")
    return rows.where(~seen).drop("event_type"), rows.where(seen).select("direction", "doc_no")


EVENT_ROWS = """
WITH rows AS (
  SELECT event_type, CASE WHEN event_type IN ('purchase', 'error') THEN 'out' ELSE 'in' END AS direction,
    user_id || '/' || regexp_extract(props, '[0-9]+') AS doc_no, ts AS issued_on, event_id AS subject FROM events),
history AS (SELECT DISTINCT direction, doc_no FROM rows WHERE event_type IN ('error', 'view')),
fresh AS (SELECT direction, doc_no, issued_on, subject FROM rows r
  WHERE event_type NOT IN ('error', 'view') AND NOT EXISTS (
    SELECT 1 FROM history h WHERE h.direction = r.direction AND h.doc_no = r.doc_no)),
once AS (SELECT direction, doc_no, issued_on, subject FROM (
  SELECT *, row_number() OVER (PARTITION BY direction, doc_no ORDER BY issued_on DESC, subject) AS rn FROM fresh)
  WHERE rn = 1)"""


def q_history_anti(spark, sf_dir):
    return S.unseen(*_event_rows(spark, sf_dir))


def q_fetch_budget(spark, sf_dir):
    return S.fetch_budget(*_event_rows(spark, sf_dir), limit=500)


def q_fetch_plan(spark, sf_dir):
    return fetch_plan(*_event_rows(spark, sf_dir))


def _hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("sha256", content_hash("text"))


def q_dedupe_first(spark, sf_dir):
    return D.first_per_content(_hashed(spark, sf_dir), "doc_id").select("doc_id", "sha256", "source")


def q_insert_new(spark, sf_dir):
    """Labelled documents count as stored already."""
    docs = _hashed(spark, sf_dir).select("doc_id", "sha256")
    stored = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return D.insert_status(docs, stored, "doc_id")


def _landing_rows(spark, sf_dir):
    docs = spread(spark, sf_dir, "documents", "doc_id")
    return docs.select(
        F.format_string("%s/%012d.txt", "source", "doc_id").alias("path"), "text",
        F.col("source").alias("side_doc_no"),
    )


def q_ingest_batch(spark, sf_dir):
    """One batch into an empty store, then the same rows again: nothing is added."""
    store = Store(spark, scratch_path(spark, "store"))
    rows = _landing_rows(spark, sf_dir)
    ingest(rows, store, "first")
    ingest(rows, store, "second")
    return store.documents().select("sha256", "file_path", "doc_no", F.length("full_text").alias("n_chars"), "batch_id")


def q_ingest_stream(spark, sf_dir):
    """The documents as landing files, taken in three micro-batches; more partitions mean more files, not larger ones."""
    landing = scratch_path(spark, "landing")
    rows = _landing_rows(spark, sf_dir)
    each = -(-max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()) // 3)
    rows.repartition(3 * each, "path").write.parquet(landing)
    store = Store(spark, scratch_path(spark, "store"))
    for _ in range(2):  # the second run finds nothing new
        ingest_landing(
            spark, landing, store, landing + "-checkpoint", rows.schema, files_per_trigger=each
        )
    return store.documents().select("sha256", F.length("full_text").alias("n_chars"))


def q_stored_chunks(spark, sf_dir):
    """Windows of all documents appended to the store, the batch replayed, then read back."""
    store = Store(spark, scratch_path(spark, "store"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("direction"))
    chunks = window_chunks(spark, sf_dir).join(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
    for _ in range(2):
        store.write_chunks(chunks, "first")
    return store.chunks().select("chunk_id", F.col("doc_id").cast("long").alias("doc_id"), "pos", "text", "direction")


def q_stored_history(spark, sf_dir):
    """Numbers seen in two batches, kept per direction, then read back from the store."""
    store = Store(spark, scratch_path(spark, "store"))
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("direction"), F.concat(F.col("user_id").cast("string"), F.lit("/KH-UBND")).alias("doc_no"),
        (F.col("event_id") % 2).alias("half"),
    )
    for half in (0, 1):
        store.write_history(events.where(F.col("half") == half), f"batch-{half}")
    return store.history().select("direction", "doc_no").distinct()


QUERIES = {
    "stored_chunks": q_stored_chunks,
    "stored_history": q_stored_history,
    "pick_main_file": q_pick_main_file,
    "no_twin": q_no_twin,
    "select_attachments": q_select_attachments,
    "group_sizes": q_group_sizes,
    "history_anti": q_history_anti,
    "fetch_budget": q_fetch_budget,
    "fetch_plan": q_fetch_plan,
    "dedupe_first": q_dedupe_first,
    "insert_new": q_insert_new,
    "ingest_batch": q_ingest_batch,
    "ingest_stream": q_ingest_stream,
}

ORACLE = {
    "stored_chunks": "WITH " + WINDOW_CHUNKS + " SELECT c.*, d.lang AS direction FROM window_chunks c JOIN documents d USING (doc_id)",
    "stored_history": "SELECT DISTINCT event_type AS direction, user_id || '/KH-UBND' AS doc_no FROM events",
    "pick_main_file": FILES + " SELECT doc_no, path, kind, size FROM main_file",
    "no_twin": FILES + " SELECT doc_no, path, kind FROM no_twin",
    "select_attachments": FILES + f"""
SELECT {FILE_COLUMNS}, 'main file' AS reason FROM main_file
UNION ALL SELECT {FILE_COLUMNS}, 'incoming pdf' FROM ruled WHERE direction = 'in' AND kind = 'pdf' AND pdf_ok
UNION ALL SELECT {FILE_COLUMNS}, 'word without pdf twin' FROM no_twin
UNION ALL SELECT {FILE_COLUMNS}, 'sheet' FROM ruled WHERE kind = 'sheet'""",
    "group_sizes": FILES + " SELECT doc_no, direction, count(*) AS n_files,"
    " CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY doc_no, direction",
    "history_anti": EVENT_ROWS + " SELECT direction, doc_no, issued_on, subject FROM fresh",
    "fetch_budget": EVENT_ROWS + """
SELECT direction, doc_no, issued_on, subject FROM once
ORDER BY CASE direction WHEN 'out' THEN 0 ELSE 1 END, issued_on DESC, doc_no LIMIT 500""",
    "fetch_plan": EVENT_ROWS
    + " SELECT direction, doc_no, issued_on, subject, replace(doc_no, '/', '_') || '_' AS file_prefix FROM once",
    "dedupe_first": """
SELECT doc_id, sha256, source FROM (
  SELECT *, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1""",
    "insert_new": """
WITH h AS (SELECT doc_id, sha256(text) AS sha256,
             row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents),
s AS (SELECT DISTINCT sha256 FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, sha256, CASE WHEN rn = 1 AND sha256 NOT IN (SELECT sha256 FROM s)
  THEN 'inserted' ELSE 'duplicate' END AS status FROM h""",
    "ingest_batch": f"""
SELECT sha256, file_path, doc_no, CAST(length({sql_strip('text')}) AS INTEGER) AS n_chars, 'first' AS batch_id FROM (
  SELECT *, source AS doc_no, source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS file_path,
    sha256(text) AS sha256,
    row_number() OVER (PARTITION BY sha256(text)
      ORDER BY source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt') AS rn FROM documents)
WHERE rn = 1 AND {sql_strip('text')} <> ''""",
    "ingest_stream": f"""
SELECT DISTINCT sha256(text) AS sha256, CAST(length({sql_strip('text')}) AS INTEGER) AS n_chars
FROM documents WHERE {sql_strip('text')} <> ''""",
}
