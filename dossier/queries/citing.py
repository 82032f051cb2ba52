"""Fuzzy matches and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators.citations import extract_citations
from dossier.operators.fuzzy import fuzzy_topk
from dossier.plans.citations import check_citations, corpus_edges
from dossier.queries.tables import spread, table


def q_trigram_top3(spark, sf_dir):
    """Every page address against all others."""
    pages = table(spark, sf_dir, "pages")
    hits = fuzzy_topk(pages, pages, probe="url", key="url", corpus_id="page_id", skip_equal=True)
    return hits.select(
        F.col("url").alias("probe"), "match_id", "match", F.round("similarity", 6).alias("similarity"), "match_rank"
    )


GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'),"
    " lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2),"
    " lambda i: substr('  ' || w || ' ', i, 3)))))"
)


def top3_cte(probes: str, corpus: str, key: str, corpus_id: str, differ: bool) -> str:
    """``best(probe, match_id, match, similarity, match_rank)`` by comparing every pair."""
    condition = "p.v <> c.v AND" if differ else ""
    return f"""p AS (SELECT v, {GRAMS.format(c='v')} AS g FROM (SELECT DISTINCT {probes})),
c AS (SELECT id, v, {GRAMS.format(c='v')} AS g FROM (SELECT {corpus_id} AS id, {key} AS v FROM {corpus})),
d AS (SELECT DISTINCT v, g FROM c),
m AS (SELECT p.v AS pv, c.v AS cv, len(list_intersect(p.g, c.g)) AS i, len(p.g) AS np, len(c.g) AS nc
      FROM p JOIN d c ON {condition} len(p.g) > 0 AND len(c.g) > 0),
s AS (SELECT pv, cv, i / CAST(np + nc - i AS DOUBLE) AS similarity FROM m
      WHERE CAST(CAST(i / CAST(np + nc - i AS DOUBLE) AS FLOAT) AS DOUBLE) > CAST(0.4 AS DOUBLE)),
best AS (SELECT * FROM (
  SELECT pv AS probe, id AS match_id, cv AS match, similarity,
    row_number() OVER (PARTITION BY pv ORDER BY similarity DESC, id) AS match_rank
  FROM s JOIN c ON s.cv = c.v) WHERE match_rank <= 3)"""


TRIGRAM_SQL = "WITH " + top3_cte("url AS v FROM pages", "pages", "url", "page_id", True) + """
SELECT probe, match_id, match, round(similarity, 6) AS similarity, CAST(match_rank AS INTEGER) AS match_rank FROM best"""


def _citing(spark, sf_dir):
    """Every sentence of a document cites the number that is the document's length."""
    docs = spread(spark, sf_dir, "documents", "doc_id")
    citation = F.concat(
        F.lit("; căn CỨ Quyết định số "), F.col("n_chars").cast("string"), F.lit("/2020/QĐ-UBND ngày ")
    )
    return docs.select(
        "doc_id",
        F.concat(F.col("doc_id").cast("string"), F.lit("/2020/QĐ-UBND")).alias("doc_no"),
        F.lit(None).cast("date").alias("issued_on"),
        F.col("source").alias("subject"),
        F.replace("text", F.lit(". "), citation).alias("text"),
    )


CITING = """
WITH docs AS (SELECT doc_id, doc_id || '/2020/QĐ-UBND' AS doc_no, source AS subject,
    replace(text, '. ', '; căn CỨ Quyết định số ' || n_chars || '/2020/QĐ-UBND ngày ') AS text FROM documents),
spans AS (SELECT doc_id, unnest(s) AS span, unnest(range(0, len(s))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '(?i)Căn cứ[^;\\n]*') AS s FROM docs)),
refs AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(span, ' ' || chr(9) || chr(13)) AS ref_text, left(trim(span, ' ' || chr(9) || chr(13)), 160) AS shown,
    regexp_extract(span, '(?i)số\\s*([0-9]+[/-][0-9A-ZĐa-zđ./\\-]+)', 1) AS code FROM spans
  WHERE regexp_extract(span, '(?i)số\\s*([0-9]+[/-][0-9A-ZĐa-zđ./\\-]+)', 1) <> '')"""


def q_refs_extract(spark, sf_dir):
    return extract_citations(_citing(spark, sf_dir))


def q_refs_resolve(spark, sf_dir):
    docs = _citing(spark, sf_dir)
    out = check_citations(docs, docs.select("doc_id", "doc_no", "issued_on", "subject"))
    numbers = F.transform("suggestions", lambda s: s["match"])
    return out.select("doc_id", "pos", "ref_text", "code", "found", F.array_join(numbers, "|").alias("suggested"))


def q_ref_edges(spark, sf_dir):
    return corpus_edges(_citing(spark, sf_dir))


TOP3_REFS = ",\n" + top3_cte("code AS v FROM refs", "docs", "doc_no", "doc_id", False)

QUERIES = {
    "trigram_top3": q_trigram_top3,
    "refs_extract": q_refs_extract,
    "refs_resolve": q_refs_resolve,
    "ref_edges": q_ref_edges,
}

ORACLE = {
    "trigram_top3": TRIGRAM_SQL,
    "refs_extract": CITING + " SELECT doc_id, pos, ref_text, shown, code FROM refs",
    "refs_resolve": CITING + TOP3_REFS + """,
listed AS (SELECT probe, string_agg(match, '|' ORDER BY match_rank) AS suggested FROM best GROUP BY probe)
SELECT doc_id, pos, ref_text, code, suggested IS NOT NULL AS found, suggested
FROM refs LEFT JOIN listed ON code = probe""",
    "ref_edges": CITING + TOP3_REFS + """,
once AS (SELECT doc_id, ref_text, arg_min(code, pos) AS code FROM refs GROUP BY doc_id, ref_text)
SELECT doc_id AS child_id, ref_text AS parent_ref_text, code AS parent_code,
  (SELECT arg_min(match_id, match_rank) FROM best WHERE probe = code AND match_id <> doc_id) AS parent_id
FROM once""",
}
