"""Scalar functions and the metadata chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import (
    content_hash, cosine, excerpt, file_kind, normalise_date, parse_reply, probe, safe_name,
    strip, strip_nul, trigrams, twin_key,
)
from dossier.functions.text import file_extension
from dossier.operators import metadata as M
from dossier.operators.assembly import assemble, choose_text
from dossier.queries.tables import spread, table

# White space as DuckDB's regular expressions need it spelled.
WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def q_text_source_choice(spark, sf_dir):
    """Document text as native text, the page of the same number as recognised text."""
    docs, pages = spread(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "pages")
    both = docs.join(pages, docs.doc_id == pages.page_id, "left").select(
        "doc_id", F.col("text").alias("native_text"), F.col("html").alias("ocr_text")
    )
    return choose_text(both).select("doc_id", "extract_method", "text")


def q_strip_nul(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marked = F.regexp_replace("text", " ", "\x00 ")
    return docs.select("doc_id", strip_nul(marked).alias("text"))


def q_excerpt_probe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    e = excerpt("text")
    return docs.select(
        "doc_id", e["head"].alias("head"), e["tail"].alias("tail"), probe("text").alias("probe"),
        probe("text", None).alias("whole_probe"),
    )


def q_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("sha256"))


def q_assemble_text(spark, sf_dir):
    """One text per conversation: the role as first cell of a row, the turn as its part."""
    turns = table(spark, sf_dir, "conversations")
    cells = F.array(F.struct(F.lit(0).alias("col"), F.col("role").alias("text")),
                    F.struct(F.lit(1).alias("col"), F.col("text").alias("text")))
    segments = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), F.lit(0).alias("row"),
        F.lit("cell").alias("kind"), F.explode(cells).alias("c"),
    ).select("doc_id", "part", "row", "kind", "c.col", "c.text")
    return assemble(segments)


REPLY = "k bigint, missing string"


def q_json_fields(spark, sf_dir):
    events = spread(spark, sf_dir, "events", "event_id")
    r = parse_reply("props", REPLY)
    return events.select("event_id", r["k"].alias("k"), r["missing"].alias("missing"))


def q_json_repair(spark, sf_dir):
    """The same replies wrapped in fences, prose or a list, or broken, by event number."""
    events = spread(spark, sf_dir, "events", "event_id")
    form = F.col("event_id") % 5
    wrapped = (
        F.when(form == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(form == 1, F.concat(F.lit("Result: "), "props", F.lit(" as asked")))
        .when(form == 2, F.concat(F.lit("["), "props", F.lit("]")))
        .when(form == 3, F.concat(F.lit("[\"text\", "), "props", F.lit("]")))
        .otherwise(F.concat(F.lit("no json "), F.col("event_type")))
    )
    return events.select("event_id", parse_reply(wrapped, REPLY)["k"].alias("k"))


def q_norm_date(spark, sf_dir):
    """Order dates in six spellings, one of them naming no day."""
    orders = table(spark, sf_dir, "orders")
    form = F.col("o_orderkey") % 6
    y, m, d = (F.date_format("o_orderdate", f) for f in ("yyyy", "M", "d"))
    written = (
        F.when(form == 0, F.concat_ws("-", y, m, d))
        .when(form == 1, F.concat_ws("/", d, m, y))
        .when(form == 2, F.concat_ws("-", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y))
        .when(form == 3, F.concat(F.lit("ngày "), F.concat_ws("/", d, m, y), F.lit(" tại")))
        .when(form == 4, F.concat(F.lit("31/02/"), y))
        .otherwise("None")
    )
    return orders.select("o_orderkey", normalise_date(written).alias("issued_on"))


def _typed_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    suffix = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "/KH-UBND")
        .when(F.col("o_orderpriority") == "2-HIGH", "/TTr-SKHCN")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "/2020/NĐ-CP")
        .when(F.col("o_orderpriority") == "5-LOW", "-NQ/TW")
        .otherwise("")
    )
    return orders.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 250000, "cong_van").otherwise("letter").alias("doc_type"),
        F.when(F.col("o_orderstatus") == "F", "BC").when(F.col("o_orderstatus") == "O", "zz").alias("type_code"),
        F.concat(F.col("o_orderkey").cast("string"), suffix).alias("doc_no"),
    )


def q_lookup_chain(spark, sf_dir):
    return M.resolve_type(_typed_orders(spark, sf_dir), M.doc_types(spark))


TYPES_SQL = "types(doc_type, type_code) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in K.DOC_TYPES) + ")"
LOOKUP_SQL = f"""
WITH {TYPES_SQL},
docs AS (
  SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'cong_van' ELSE 'letter' END AS given,
    CASE o_orderstatus WHEN 'F' THEN 'BC' WHEN 'O' THEN 'zz' END AS code,
    o_orderkey || CASE o_orderpriority WHEN '1-URGENT' THEN '/KH-UBND' WHEN '2-HIGH' THEN '/TTr-SKHCN'
      WHEN '3-MEDIUM' THEN '/2020/NĐ-CP' WHEN '5-LOW' THEN '-NQ/TW' ELSE '' END AS doc_no
  FROM orders),
chosen AS (
  SELECT o_orderkey, doc_no, coalesce(
    (SELECT doc_type FROM types WHERE doc_type = given),
    (SELECT doc_type FROM types WHERE type_code = code AND type_code <> ''),
    (SELECT doc_type FROM types WHERE type_code <> ''
       AND upper(type_code) = upper(regexp_extract(doc_no, '[/\\-]([A-ZĐa-zđ]+)', 1))),
    'khac') AS doc_type
  FROM docs)
SELECT c.o_orderkey, c.doc_no, c.doc_type, t.type_code FROM chosen c JOIN types t USING (doc_type)"""


def q_array_clean(spark, sf_dir):
    docs = spread(spark, sf_dir, "documents", "doc_id")
    words = F.split("text", "[ \\n]", -1)
    return docs.select(
        "doc_id", M.clean_topics(words).alias("topics"), M.clean_list(words).alias("policies"),
        M.clean_fields(words, ("the", "la", "der", "que", "of", "de")).alias("fields"),
    )


def q_role_clean(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", M.clean_role("role", ("assistant", "system")).alias("role"))


def q_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_name("url").alias("safe_name"))


def q_twin_key(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.lit("_"), F.regexp_extract("url", "([^/]*)$", 1))
    ext = file_extension(name)
    return pages.select(
        "page_id", twin_key(name).alias("twin_key"), ext.alias("ext"), file_kind(ext).alias("kind")
    )


def q_value_locks(spark, sf_dir):
    """Every document as extracted metadata; its label, where there is one, as the sidecar."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    day = F.col("doc_id") % 28 + 1
    quality = F.col("quality")
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("n_chars") > 1000, F.col("source")).alias("doc_no"),
        F.concat(F.lit("2024-3-"), day.cast("string")).alias("issued_on"),
        F.col("lang").alias("subject"),
        F.col("source").alias("issuer"),
        F.when(quality == 1, F.concat(F.lit("L"), F.col("doc_id").cast("string"))).alias("side_doc_no"),
        F.when(quality == 1, F.concat_ws("/", day.cast("string"), F.lit("4"), F.lit("2023")))
        .when(quality == 0, F.lit("4/2023")).alias("side_issued_on"),
        F.when(F.col("toxic") == 1, "").alias("side_subject"),
        F.when(F.col("toxic") == 1, "office").when(quality == 0, "").alias("side_issuer"),
    )
    return M.lock_values(rows).select("doc_id", "doc_no", "issued_on", "subject", "issuer")


VALUE_LOCKS_SQL = """
SELECT d.doc_id,
  CASE WHEN l.quality = 1 THEN 'L' || d.doc_id ELSE CASE WHEN d.n_chars > 1000 THEN d.source END END AS doc_no,
  CASE WHEN l.quality = 1 THEN '2023-04-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0')
       ELSE '2024-03-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS issued_on,
  CASE WHEN l.toxic = 1 THEN '' ELSE d.lang END AS subject,
  CASE WHEN l.toxic = 1 THEN 'office' ELSE d.source END AS issuer
FROM documents d LEFT JOIN labels l USING (doc_id)"""


def q_trigrams(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(trigrams("url")).alias("grams"))


TRIGRAMS_SQL = """
SELECT page_id, list_sort(list_distinct(flatten(list_transform(
  list_filter(regexp_split_to_array(lower(url), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS grams
FROM pages"""


def q_label_cosine(spark, sf_dir):
    """Cosine of every vector with the element-wise mean of its label's vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    mean = (
        vectors.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"))
        .select("label", F.transform("ms", lambda s: s["m"]).alias("mean"))
    )
    return vectors.join(mean, "label").select(
        "vec_id", "label", F.round(cosine("embedding", "mean"), 6).alias("score")
    )


LABEL_COSINE_SQL = """
WITH flat AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings),
m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM flat GROUP BY label, i),
means AS (SELECT label, list(m ORDER BY i) AS mean FROM m GROUP BY label)
SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), mean), 6) AS score
FROM embeddings e JOIN means USING (label)"""

QUERIES = {
    "text_source_choice": q_text_source_choice,
    "strip_nul": q_strip_nul,
    "excerpt_probe": q_excerpt_probe,
    "content_hash": q_content_hash,
    "assemble_text": q_assemble_text,
    "json_fields": q_json_fields,
    "json_repair": q_json_repair,
    "norm_date": q_norm_date,
    "lookup_chain": q_lookup_chain,
    "array_clean": q_array_clean,
    "role_clean": q_role_clean,
    "safe_name": q_safe_name,
    "twin_key": q_twin_key,
    "value_locks": q_value_locks,
    "trigrams": q_trigrams,
    "label_cosine": q_label_cosine,
}

ORACLE = {
    "text_source_choice": f"""
WITH s AS (SELECT doc_id, coalesce({sql_strip('text')}, '') AS own, coalesce({sql_strip('html')}, '') AS seen
           FROM documents LEFT JOIN pages ON doc_id = page_id)
SELECT doc_id, CASE WHEN length(own) >= 50 THEN 'pdf_text' WHEN seen <> '' THEN 'ocr_tesseract'
  ELSE 'ocr_failed' END AS extract_method,
  nullif(CASE WHEN length(own) >= 50 THEN own ELSE seen END, '') AS text FROM s""",
    "strip_nul": "SELECT doc_id, text FROM documents",
    "excerpt_probe": f"""
WITH c AS (SELECT doc_id, text, regexp_replace(text, '{WS}+', ' ', 'g') AS p FROM documents)
SELECT doc_id, left(text, 3000) AS head, right(text, 1500) AS tail, left(p, 600) AS probe,
  p AS whole_probe FROM c""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "assemble_text": f"""
SELECT conv_id AS doc_id,
  {sql_strip("string_agg(role || chr(9) || text, chr(10) ORDER BY turn)")} AS text
FROM conversations GROUP BY conv_id""",
    "json_fields": """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events""",
    "json_repair": """
SELECT event_id, CASE WHEN event_id % 5 <= 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
    "norm_date": """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 3 THEN CAST(o_orderdate AS DATE) END AS issued_on FROM orders""",
    "lookup_chain": LOOKUP_SQL,
    "array_clean": f"""
WITH w AS (SELECT doc_id, regexp_split_to_array(text, '[ \\n]') AS words FROM documents)
SELECT doc_id,
  list_transform(list_filter(words[1:8], lambda x: x <> ''), lambda x: {sql_strip('x')}) AS topics,
  list_transform(list_filter(words, lambda x: x <> ''), lambda x: {sql_strip('x')}) AS policies,
  list_filter(words, lambda x: x IN ('the', 'la', 'der', 'que', 'of', 'de')) AS fields
FROM w""",
    "role_clean": """
SELECT conv_id, turn, CASE WHEN role IN ('assistant', 'system') THEN role ELSE 'khac' END AS role FROM conversations""",
    "safe_name": f"""
SELECT page_id, {sql_strip("regexp_replace(url, '[\\\\/*?:\"<>|]', '_', 'g')")} AS safe_name FROM pages""",
    "twin_key": """
WITH n AS (SELECT page_id, page_id || '_' || regexp_extract(url, '([^/]*)$', 1) AS name FROM pages),
e AS (SELECT page_id, name, lower(regexp_extract(name, '[^/.][^/]*[.]([^./]*)$', 1)) AS ext FROM n)
SELECT page_id, ext, regexp_replace(regexp_replace(lower(name), '([^/.])[.][^./]*$', '\\1'), '^[0-9]+_', '') AS twin_key,
  CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('xls', 'xlsx', 'csv') THEN 'sheet'
       WHEN ext IN ('doc', 'docx') THEN 'word' ELSE 'other' END AS kind FROM e""",
    "value_locks": VALUE_LOCKS_SQL,
    "trigrams": TRIGRAMS_SQL,
    "label_cosine": LABEL_COSINE_SQL,
}
