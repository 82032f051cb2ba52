"""Figures totalled over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import figures as G
from dossier.plans.figures import aggregate_figures, keyword_hits
from dossier.queries.search import _hybrid_cte, _rerank_cte
from dossier.queries.tables import corpus, search_queries, spread, table
from dossier.queries.texts import sql_strip


def _docs(spark, sf_dir):
    docs = spread(spark, sf_dir, "documents", "doc_id")
    return docs.select(
        "doc_id", "text", F.col("lang").alias("doc_type"), F.col("source").alias("doc_no"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).alias("issued_on"),
    )


def _questions(spark, sf_dir, agg):
    """One question per language, and one over all languages, dates and the keyword ``the``."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    none = F.lit(None)
    each = langs.select(
        F.col("lang").alias("question_id"), F.lit(agg).alias("agg"), F.col("lang").alias("doc_type"),
        none.cast("date").alias("date_from"), none.cast("date").alias("date_to"),
        none.cast("string").alias("keyword"),
    )
    whole = langs.agg(F.max("lang")).select(
        F.lit("any").alias("question_id"), F.lit(agg).alias("agg"), none.cast("string").alias("doc_type"),
        F.lit("2024-03-01").cast("date").alias("date_from"), F.lit("2024-10-31").cast("date").alias("date_to"),
        F.lit("The").alias("keyword"),
    )
    return each.unionByName(whole).withColumn("pattern", F.lit(G.FIGURE_PATTERN))


def q_figures_sum(spark, sf_dir):
    return aggregate_figures(_questions(spark, sf_dir, "sum"), _docs(spark, sf_dir))[0]


def q_figures_count(spark, sf_dir):
    return aggregate_figures(_questions(spark, sf_dir, "count"), _docs(spark, sf_dir))[0]


def q_figures_evidence(spark, sf_dir):
    return aggregate_figures(_questions(spark, sf_dir, "sum"), _docs(spark, sf_dir))[1]


def q_figures_by_unit(spark, sf_dir):
    questions, docs = _questions(spark, sf_dir, "sum"), _docs(spark, sf_dir)
    found = G.extract_figures(G.candidates(questions, docs), questions, docs)
    return G.totals_by_unit(questions, found)


def q_newest_candidates(spark, sf_dir):
    """The newest sixty documents of each question."""
    return G.candidates(_questions(spark, sf_dir, "sum"), _docs(spark, sf_dir), 60)


def q_narrow_semi(spark, sf_dir):
    """Each benchmark item as keywords, its candidates the documents of one language."""
    queries = search_queries(spark, sf_dir)
    questions = queries.select(
        F.col("query_id").alias("question_id"), F.col("text").alias("keywords"), "embedding",
        F.col("direction").alias("doc_type"),
        F.lit(None).cast("date").alias("date_from"), F.lit(None).cast("date").alias("date_to"),
    )
    chunks = corpus(spark, sf_dir).withColumn("doc_id", F.col("chunk_id"))
    pairs = G.candidates(questions, _docs(spark, sf_dir))
    return G.narrow(pairs, keyword_hits(questions, chunks))


NUM = "([0-9]+(?:[.][0-9]+)?)[ \\t]*([\\p{L}%]*)"


def _figures_cte(agg: str) -> str:
    return f"""
WITH docs AS (SELECT doc_id, text, lang AS doc_type, source AS doc_no,
    DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS issued_on FROM documents),
questions AS (
  SELECT DISTINCT lang AS question_id, '{agg}' AS agg, lang AS doc_type, CAST(NULL AS DATE) AS date_from,
    CAST(NULL AS DATE) AS date_to, CAST(NULL AS VARCHAR) AS keyword FROM documents
  UNION ALL
  SELECT 'any', '{agg}', NULL, DATE '2024-03-01', DATE '2024-10-31', 'The'),
pairs AS (SELECT question_id, agg, keyword, doc_id, text, doc_no, issued_on FROM questions q JOIN docs d
  ON (q.doc_type IS NULL OR q.doc_type = d.doc_type) AND (date_from IS NULL OR issued_on >= date_from)
     AND (date_to IS NULL OR issued_on <= date_to)),
found AS (SELECT question_id, agg, doc_id, doc_no, issued_on, list_filter(list_transform(
      regexp_split_to_array(text, '[.!?]+\\s+|\\n+'), lambda s: {sql_strip('s')}),
      lambda s: s <> '' AND (keyword IS NULL OR contains(lower(s), lower(keyword)))
                AND regexp_matches(s, '{NUM}'))[1] AS evidence FROM pairs),
figures AS (SELECT *, regexp_extract(evidence, '{NUM}', 1) AS value,
    nullif(regexp_extract(evidence, '{NUM}', 2), '') AS unit FROM found WHERE evidence IS NOT NULL)"""


TOTALS_OUT = """,
scanned AS (SELECT question_id, count(*) AS n FROM pairs GROUP BY question_id),
summed AS (SELECT question_id, count(*) AS n,
    CAST(sum(CASE WHEN agg = 'count' THEN 1 ELSE CAST(value AS DECIMAL(30, 10)) END) AS DOUBLE) AS total
  FROM figures GROUP BY question_id)
SELECT q.question_id, q.agg, coalesce(total, 0) AS total, coalesce(s.n, 0) AS n_docs_scanned,
  coalesce(m.n, 0) AS n_docs_matched, false AS truncated, false AS narrowed
FROM questions q LEFT JOIN scanned s USING (question_id) LEFT JOIN summed m USING (question_id)"""

QUERIES = {
    "figures_sum": q_figures_sum,
    "figures_count": q_figures_count,
    "figures_evidence": q_figures_evidence,
    "figures_by_unit": q_figures_by_unit,
    "newest_candidates": q_newest_candidates,
    "narrow_semi": q_narrow_semi,
}

ORACLE = {
    "figures_sum": _figures_cte("sum") + TOTALS_OUT,
    "figures_count": _figures_cte("count") + TOTALS_OUT,
    "figures_evidence": _figures_cte("sum")
    + " SELECT question_id, doc_id, doc_no, issued_on, value, unit, evidence FROM figures",
    "figures_by_unit": _figures_cte("sum") + """
SELECT question_id, unit, CAST(sum(CAST(value AS DECIMAL(30, 10))) AS DOUBLE) AS total,
  count(*) AS n_docs_matched FROM figures GROUP BY question_id, unit""",
    "newest_candidates": _figures_cte("sum") + """
SELECT question_id, doc_id, n > 60 AS truncated FROM (SELECT question_id, doc_id, row_number() OVER (
  PARTITION BY question_id ORDER BY issued_on DESC, doc_id) AS rn, count(*) OVER (PARTITION BY question_id) AS n FROM pairs) WHERE rn <= 60""",
    "narrow_semi": _hybrid_cte(False, 60) + _rerank_cte(40) + """,
cand AS (SELECT q.query_id AS question_id, d.doc_id FROM queries q JOIN documents d
         ON q.direction IS NULL OR q.direction = d.lang),
marked AS (SELECT c.*, r.chunk_id IS NOT NULL AS hit FROM cand c LEFT JOIN reranked r
           ON r.query_id = c.question_id AND r.chunk_id = c.doc_id),
per AS (SELECT question_id, count(*) AS n, count(*) FILTER (WHERE hit) AS kept FROM marked GROUP BY question_id)
SELECT question_id, doc_id, false AS truncated, n > 15 AND kept > 0 AND kept < n AS narrowed
FROM marked JOIN per USING (question_id) WHERE hit OR n <= 15 OR kept = 0""",
}
