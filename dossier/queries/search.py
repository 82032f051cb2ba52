"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators.dense import dense_topk
from dossier.operators.fusion import context, rerank, rrf, sources
from dossier.operators.sparse import sparse_topk, sparse_weights
from dossier.operators.stored import dense_topk_stored, sparse_topk_stored
from dossier.plans.search import candidates, candidates_stored, draft_check_context, hybrid_search, search_stored
from dossier.queries.tables import (
    CORPUS, QUERIES_CTE, WINDOW_CHUNKS, corpus, search_queries, spread, table, window_chunks,
)
from dossier.session import scratch_path
from dossier.sources.index import ChunkIndex

FILTERS = ("doc_type", "direction")


def _index(spark) -> ChunkIndex:
    return ChunkIndex(spark, scratch_path(spark, "index"))


def q_dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    hits = dense_topk(
        vectors.withColumnRenamed("vec_id", "query_id"),
        vectors.withColumnRenamed("vec_id", "chunk_id"),
        10,
        skip_same_id=True,
    )
    return hits.select("query_id", "chunk_id", F.round("dense_score", 6).alias("score"), "dense_rank")


DENSE_SQL = """
SELECT query_id, chunk_id, round(s, 6) AS score, CAST(r AS INTEGER) AS dense_rank FROM (
  SELECT query_id, chunk_id, s,
         row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
               round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
WHERE r <= 10"""


def q_sparse_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = sparse_topk(queries, window_chunks(spark, sf_dir), 2 * K.SEARCH_POOL)
    return hits.select("query_id", "chunk_id", F.round("sparse_score", 6).alias("score"), "sparse_rank")


def q_dense_topk_stored(spark, sf_dir):
    """Every vector against all others, out of an index written from the table."""
    vectors = table(spark, sf_dir, "embeddings")
    index = _index(spark).write(vectors, chunk_id="vec_id", text=None)
    hits = dense_topk_stored(vectors.withColumnRenamed("vec_id", "query_id"), index, 10, skip_same_id=True)
    return hits.select("query_id", "chunk_id", F.round("dense_score", 6).alias("score"), "dense_rank")


def q_sparse_topk_stored(spark, sf_dir):
    index = _index(spark).write(window_chunks(spark, sf_dir), vector=None)
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = sparse_topk_stored(queries, index, 2 * K.SEARCH_POOL)
    return hits.select("query_id", "chunk_id", F.round("sparse_score", 6).alias("score"), "sparse_rank")


def _corpus_index(spark, sf_dir):
    return _index(spark).write(corpus(spark, sf_dir), payload=[*FILTERS, "doc_no", "issued_on"])


def q_hybrid_stored(spark, sf_dir):
    fused = candidates_stored(search_queries(spark, sf_dir), _corpus_index(spark, sf_dir), K.SEARCH_POOL, FILTERS)
    return fused.select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "fused_rank")


def q_context_stored(spark, sf_dir):
    """The answer context again, from the index alone."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    hits = search_stored(search_queries(spark, sf_dir), _corpus_index(spark, sf_dir), filters=FILTERS, keep=["doc_no", "issued_on"])
    return context(queries, hits)


def _bm25_cte(chunks: str, filtered: bool, limit: int) -> str:
    condition = (
        "WHERE (q.doc_type IS NULL OR q.doc_type = c.doc_type)"
        " AND (q.direction IS NULL OR q.direction = c.direction)"
        if filtered else ""
    )
    keep = ", doc_type, direction" if filtered else ""
    return f"""c_tok AS (
  SELECT chunk_id{keep}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM {chunks}),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM c_tok),
c_tf AS (SELECT chunk_id{keep}, dl, term, count(*) AS tf
         FROM (SELECT chunk_id{keep}, len(t) AS dl, unnest(t) AS term FROM c_tok) GROUP BY ALL),
c_df AS (SELECT term, count(*) AS df FROM c_tf GROUP BY term),
c_w AS (SELECT chunk_id{keep}, term,
          ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf,
          tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl)) AS w
        FROM c_tf JOIN c_df USING (term), stats),
q_tf AS (SELECT query_id{keep}, term, count(*) AS qtf FROM (
           SELECT query_id{keep}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term
           FROM queries) GROUP BY ALL),
sparse AS (SELECT * FROM (
  SELECT query_id, chunk_id, sparse_score,
         row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, chunk_id) AS sparse_rank
  FROM (SELECT query_id, chunk_id, round(sum(qtf * idf * w), 9) AS sparse_score
        FROM q_tf q JOIN c_w c USING (term) {condition} GROUP BY query_id, chunk_id))
  WHERE sparse_rank <= {limit})"""


SPARSE_SQL = (
    "WITH queries AS (SELECT item_id AS query_id, text FROM benchmark),\n"
    + WINDOW_CHUNKS + ",\n" + _bm25_cte("window_chunks", False, 48)
    + "\nSELECT query_id, chunk_id, round(sparse_score, 6) AS score,"
    + " CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse"
)


def q_sparse_weights(spark, sf_dir):
    docs = spread(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return sparse_weights(docs).select("chunk_id", "term", F.round("weight", 6).alias("weight"))


SPARSE_WEIGHTS_SQL = (
    "WITH c_tok AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t"
    " FROM documents),\n"
    "stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM c_tok),\n"
    "c_tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl,"
    " unnest(t) AS term FROM c_tok) GROUP BY ALL),\n"
    "c_df AS (SELECT term, count(*) AS df FROM c_tf GROUP BY term)\n"
    "SELECT chunk_id, term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) *"
    " (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS weight\n"
    "FROM c_tf JOIN c_df USING (term), stats"
)


def _hybrid_cte(filtered: bool, pool: int) -> str:
    where = "WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL" + (
        " AND (q.doc_type IS NULL OR q.doc_type = c.doc_type)"
        " AND (q.direction IS NULL OR q.direction = c.direction)"
        if filtered else ""
    )
    return (
        "WITH " + CORPUS + ",\n" + QUERIES_CTE + ",\n"
        + _bm25_cte("corpus", filtered, 2 * pool)
        + f""",
dense AS (SELECT * FROM (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS dense_rank
  FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(
          CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS s
        FROM queries q CROSS JOIN corpus c {where}))
  WHERE dense_rank <= {2 * pool}),
fused AS (SELECT * FROM (
  SELECT query_id, chunk_id, rrf_score,
         row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS fused_rank
  FROM (SELECT query_id, chunk_id,
               coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS rrf_score
        FROM dense FULL OUTER JOIN sparse USING (query_id, chunk_id)))
  WHERE fused_rank <= {pool})"""
    )


def _rerank_cte(top: int) -> str:
    return f""",
terms AS (SELECT f.query_id, f.chunk_id, f.fused_rank, c.text, c.doc_no, c.issued_on, c.direction,
    list_distinct(regexp_extract_all(lower(q.text), '[\\p{{L}}\\p{{N}}]+')) AS wanted,
    regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}]+') AS present
  FROM fused f JOIN corpus c USING (chunk_id) JOIN queries q USING (query_id)),
reranked AS (SELECT * FROM (
  SELECT query_id, chunk_id, text, doc_no, issued_on, direction, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank
  FROM (SELECT *, CASE WHEN len(wanted) > 0 THEN len(list_intersect(wanted, present)) / len(wanted)::DOUBLE
                  ELSE 0 END AS score FROM terms))
  WHERE rank <= {top})"""


def q_rrf(spark, sf_dir):
    fused = candidates(search_queries(spark, sf_dir), corpus(spark, sf_dir), K.SEARCH_POOL)
    return fused.select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "fused_rank")


RRF_OUT = (
    "\nSELECT query_id, chunk_id, round(rrf_score, 6) AS rrf_score,"
    " CAST(fused_rank AS INTEGER) AS fused_rank FROM fused"
)


def q_hybrid_filtered(spark, sf_dir):
    fused = candidates(
        search_queries(spark, sf_dir), corpus(spark, sf_dir), K.SEARCH_POOL, FILTERS
    )
    return fused.select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "fused_rank")


def _hits(spark, sf_dir, filters=()):
    keep = ["doc_no", "issued_on"] + ([] if filters else ["direction"])
    return hybrid_search(
        search_queries(spark, sf_dir), corpus(spark, sf_dir), filters=filters, keep=keep
    )


def q_rerank(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


RERANK_OUT = (
    "\nSELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM reranked"
)


def q_context(spark, sf_dir):
    """Context for every benchmark item; an item without a vector is found by its terms alone."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return context(queries, _hits(spark, sf_dir, FILTERS))


CONTEXT_OUT = """
SELECT b.item_id AS query_id, coalesce(c, 'Không tìm thấy thông tin trong kho dữ liệu.') AS context,
       c IS NOT NULL AS found
FROM benchmark b LEFT JOIN (
  SELECT query_id, string_agg(chr(10) || '[Đoạn ' || rank || ' | ' || doc_no || ' - ' || coalesce(CAST(issued_on AS VARCHAR), '?') || '] '
         || text || chr(10), '' ORDER BY rank) AS c FROM reranked GROUP BY query_id) r
  ON b.item_id = r.query_id"""


def q_sources(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    hits = _hits(spark, sf_dir).withColumn("score", F.round("score", 6))
    return sources(queries, hits, ["doc_no", "direction"])


SOURCES_OUT = """
SELECT b.item_id AS query_id, coalesce(s, '[]') AS sources FROM benchmark b LEFT JOIN (
  SELECT query_id, '[' || string_agg(CAST(to_json({'text': text,
      'metadata': {'doc_no': doc_no, 'direction': direction}, 'score': round(score, 6)}) AS VARCHAR),
      ',' ORDER BY rank) || ']' AS s FROM reranked GROUP BY query_id) r
  ON b.item_id = r.query_id"""


def q_draft_context(spark, sf_dir):
    """Every benchmark passage as a draft, its whole text as probe, whole passages as context."""
    drafts = search_queries(spark, sf_dir)
    return draft_check_context(drafts, corpus(spark, sf_dir))


DRAFT_OUT = """
SELECT q.query_id, coalesce(c, '') AS context FROM queries q LEFT JOIN (
  SELECT query_id, string_agg('[' || doc_no || '] ' || text, chr(10) ORDER BY rank) AS c
  FROM reranked GROUP BY query_id) r USING (query_id)"""

QUERIES = {
    "rrf": q_rrf,
    "dense_topk": q_dense_topk,
    "sparse_topk": q_sparse_topk,
    "sparse_weights": q_sparse_weights,
    "hybrid_filtered": q_hybrid_filtered,
    "rerank": q_rerank,
    "context": q_context,
    "sources": q_sources,
    "draft_context": q_draft_context,
    "dense_topk_stored": q_dense_topk_stored,
    "sparse_topk_stored": q_sparse_topk_stored,
    "hybrid_stored": q_hybrid_stored,
    "context_stored": q_context_stored,
}

ORACLE = {
    "rrf": _hybrid_cte(False, 24) + RRF_OUT,
    "dense_topk": DENSE_SQL,
    "sparse_topk": SPARSE_SQL,
    "sparse_weights": SPARSE_WEIGHTS_SQL,
    "hybrid_filtered": _hybrid_cte(True, 24) + RRF_OUT,
    "rerank": _hybrid_cte(False, 24) + _rerank_cte(8) + RERANK_OUT,
    "context": _hybrid_cte(True, 24) + _rerank_cte(8) + CONTEXT_OUT,
    "sources": _hybrid_cte(False, 24) + _rerank_cte(8) + SOURCES_OUT,
    "draft_context": _hybrid_cte(False, 20) + _rerank_cte(6) + DRAFT_OUT,
    "dense_topk_stored": DENSE_SQL,
    "sparse_topk_stored": SPARSE_SQL,
    "hybrid_stored": _hybrid_cte(True, 24) + RRF_OUT,
    "context_stored": _hybrid_cte(True, 24) + _rerank_cte(8) + CONTEXT_OUT,
}
