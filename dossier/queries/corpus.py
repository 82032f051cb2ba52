"""Statistics, listings and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import stats as S
from dossier.operators import substrings as G
from dossier.operators.chunking import (
    chunk_counts, chunk_table, fixed_chunks, integrity, structural_chunks, with_payload,
)
from dossier.plans.statistics import corpus_stats
from dossier.queries.tables import WINDOW_CHUNKS, spread, table, window_chunks
from dossier.session import scratch_path
from dossier.sources.store import Store, read_documents

WITH_CHUNKS = "WITH " + WINDOW_CHUNKS + "\n"


def q_stats_totals(spark, sf_dir):
    return S.totals(table(spark, sf_dir, "documents"), window_chunks(spark, sf_dir))


def q_stats_by_type(spark, sf_dir):
    return S.count_by(table(spark, sf_dir, "documents"), "source")


def q_stats_by_direction(spark, sf_dir):
    return S.count_by(table(spark, sf_dir, "documents"), "lang")


def q_stats_grouped(spark, sf_dir):
    return S.count_by_each(table(spark, sf_dir, "documents"), ["source", "lang"])


def q_top_tags(spark, sf_dir):
    docs = spread(spark, sf_dir, "documents", "doc_id")
    words = F.array_distinct(F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""))
    return S.top_tags(docs.select(words.alias("tags")), "tags")


def q_newest_100(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    return S.newest(orders, "o_orderdate", "o_orderkey")


def q_search_newest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    hits = S.matching(orders, "uRg_nt", ["o_orderpriority", "o_orderstatus"])
    return S.newest(hits, "o_orderdate", "o_orderkey")


def q_search_parts(spark, sf_dir):
    return S.matching(table(spark, sf_dir, "part"), "Ring", ["p_name", "p_type"])


def q_filter_optional(spark, sf_dir):
    return S.optional_filter(
        table(spark, sf_dir, "orders"), doc_type="F", date_from="1996-01-01", date_to="1998-06-30",
        type_column="o_orderstatus", date_column="o_orderdate",
    )


def q_document_read(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return read_documents(
        orders, F.col("o_orderstatus") == "O", K.READ_LIMIT,
        ["o_orderkey", "o_orderdate", "o_orderpriority"], "o_orderdate", "o_orderkey",
    )


def q_chunk_fixed(spark, sf_dir):
    return window_chunks(spark, sf_dir)


def q_chunk_counts(spark, sf_dir):
    return chunk_counts(window_chunks(spark, sf_dir))


def q_chunk_structural(spark, sf_dir):
    docs = spread(spark, sf_dir, "documents", "doc_id")
    return chunk_table(docs, structural_chunks("text"))


def q_chunk_payload(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return with_payload(window_chunks(spark, sf_dir), docs, ["source", "lang"])


def q_integrity(spark, sf_dir):
    """Windows of every document against the documents that were labelled, both ways round."""
    return integrity(table(spark, sf_dir, "labels").select("doc_id"), window_chunks(spark, sf_dir))


def q_corpus_stats(spark, sf_dir):
    """All documents as three batches, the last one written again, and the batches' counts added up."""
    store = Store(spark, scratch_path(spark, "store"))
    docs = spread(spark, sf_dir, "documents", "doc_id").join(chunk_counts(window_chunks(spark, sf_dir)), "doc_id", "left")
    words = F.array_distinct(F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""))
    rows = docs.select("doc_id", F.col("source").alias("doc_type"), F.col("lang").alias("direction"), words.alias("topics"), "n_chunks")
    for part in (0, 1, 2, 2):
        store.write_counts(S.partial_counts(rows.where(F.col("doc_id") % 3 == part)), f"batch-{part}")
    return corpus_stats(store)


def _terms(spark, sf_dir):
    """Pieces of every part's name and type as search terms, some with wildcards, some in capitals."""
    part = table(spark, sf_dir, "part")
    each = F.array(
        F.substring("p_name", 2, 6), F.upper(F.substring("p_name", 1, 4)), F.concat(F.substring("p_name", 1, 3), F.lit("_"), F.substring("p_name", 5, 3)),
        F.concat(F.substring("p_type", 1, 5), F.lit("%"), F.substring("p_type", -4, 4)), F.substring("p_type", 1, 2),
    )
    return part.select(F.explode(each).alias("term")).distinct()


TERMS = """terms AS (
  SELECT DISTINCT unnest([substr(p_name, 2, 6), upper(substr(p_name, 1, 4)), substr(p_name, 1, 3) || '_' || substr(p_name, 5, 3),
    substr(p_type, 1, 5) || '%' || right(p_type, 4), substr(p_type, 1, 2)]) AS term FROM part)"""


def q_search_terms(spark, sf_dir):
    """Every term over every part."""
    hits = G.match_terms(table(spark, sf_dir, "part"), _terms(spark, sf_dir), ["p_name", "p_type"], id_column="p_partkey")
    return hits.withColumnRenamed("id", "p_partkey")


def q_search_terms_newest(spark, sf_dir):
    """Words of the benchmark searched in all documents; the newest documents of each, by a date from their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_chars").cast("int") % 365).alias("issued_on"))
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(F.split("text", "[ \\n]+"))).alias("term")).where("length(term) > 3").distinct()
    return G.newest_per_term(docs, terms, ["text"], date_column="issued_on", limit=20)


QUERIES = {
    "corpus_stats": q_corpus_stats,
    "search_terms": q_search_terms,
    "search_terms_newest": q_search_terms_newest,
    "stats_totals": q_stats_totals,
    "stats_by_type": q_stats_by_type,
    "stats_by_direction": q_stats_by_direction,
    "stats_grouped": q_stats_grouped,
    "top_tags": q_top_tags,
    "newest_100": q_newest_100,
    "search_newest": q_search_newest,
    "search_parts": q_search_parts,
    "filter_optional": q_filter_optional,
    "document_read": q_document_read,
    "chunk_fixed": q_chunk_fixed,
    "chunk_counts": q_chunk_counts,
    "chunk_structural": q_chunk_structural,
    "chunk_payload": q_chunk_payload,
    "integrity": q_integrity,
}

ORACLE = {
    "corpus_stats": WITH_CHUNKS + """
SELECT 'documents' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS cnt FROM documents
UNION ALL SELECT 'chunks', NULL, count(*) FROM window_chunks
UNION ALL SELECT 'doc_type', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'direction', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'topic', tag, cnt FROM (
  SELECT tag, count(*) AS cnt FROM (
    SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS tag FROM documents)
  WHERE tag <> '' GROUP BY tag ORDER BY cnt DESC, tag LIMIT 10)""",
    "search_terms": "WITH " + TERMS + """
SELECT DISTINCT term, p_partkey FROM terms JOIN part ON p_name ILIKE '%' || term || '%' OR p_type ILIKE '%' || term || '%'""",
    "search_terms_newest": """
WITH terms AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS term FROM benchmark) WHERE length(term) > 3),
docs AS (SELECT doc_id, text, DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER) AS issued_on FROM documents)
SELECT term, doc_id, issued_on, CAST(n AS INTEGER) AS hit_rank FROM (
  SELECT term, doc_id, issued_on, row_number() OVER (PARTITION BY term ORDER BY issued_on DESC, doc_id) AS n
  FROM terms JOIN docs ON contains(lower(text), lower(term))) WHERE n <= 20""",
    "stats_totals": WITH_CHUNKS + "SELECT (SELECT count(*) FROM documents) AS total_docs,"
    " (SELECT count(*) FROM window_chunks) AS total_chunks",
    "stats_by_type": "SELECT source, count(*) AS cnt FROM documents WHERE source IS NOT NULL GROUP BY source",
    "stats_by_direction": "SELECT lang, count(*) AS cnt FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "stats_grouped": """
SELECT 'source' AS dimension, source AS value, count(*) AS cnt FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL
SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang""",
    "top_tags": """
SELECT tag, count(*) AS cnt FROM (
  SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS tag FROM documents)
WHERE tag <> '' GROUP BY tag ORDER BY cnt DESC, tag LIMIT 10""",
    "newest_100": """
SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100""",
    "search_newest": """
SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderpriority ILIKE '%uRg_nt%' OR o_orderstatus ILIKE '%uRg_nt%'
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100""",
    "search_parts": "SELECT * FROM part WHERE p_name ILIKE '%Ring%' OR p_type ILIKE '%Ring%'",
    "filter_optional": """
SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1996-01-01'
AND o_orderdate <= DATE '1998-06-30'""",
    "document_read": """
SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500""",
    "chunk_fixed": WITH_CHUNKS + "SELECT chunk_id, doc_id, pos, text FROM window_chunks",
    "chunk_counts": WITH_CHUNKS
    + "SELECT doc_id, CAST(count(*) AS INTEGER) AS n_chunks FROM window_chunks GROUP BY doc_id",
    "chunk_payload": WITH_CHUNKS
    + "SELECT c.chunk_id, c.doc_id, c.pos, c.text, d.source, d.lang FROM window_chunks c JOIN documents d USING (doc_id)",
    "integrity": WITH_CHUNKS + """
SELECT 'document_without_chunks' AS problem, doc_id, CAST(NULL AS VARCHAR) AS chunk_id
FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM window_chunks)
UNION ALL
SELECT 'chunk_without_document', doc_id, chunk_id FROM window_chunks
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
}
