"""Hybrid search for a whole table of queries, and the corpus check of drafts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from dossier import constants as K
from dossier.functions.text import probe
from dossier.operators.dense import dense_topk
from dossier.operators.fusion import context, draft_context, query_term_share, rerank, rrf, sources
from dossier.operators.sparse import sparse_topk
from dossier.operators.stored import dense_topk_stored, sparse_topk_stored
from dossier.session import cut_lineage
from dossier.sources.index import ChunkIndex


def candidates(
    queries: DataFrame, chunks: DataFrame, pool: int, filters: Sequence[str] = (), **options
) -> DataFrame:
    """Best ``pool`` chunks per query by both lists; each list is cut at twice the pool."""
    dense = dense_topk(queries, chunks, 2 * pool, filters=filters)
    sparse = sparse_topk(queries, chunks, 2 * pool, filters=filters)
    return rrf(dense, sparse, pool, **options)


def candidates_stored(queries: DataFrame, index: ChunkIndex, pool: int, filters: Sequence[str] = (), **options) -> DataFrame:
    """``candidates`` over a stored index; the filter columns are payload of the index."""
    dense = dense_topk_stored(queries, index, 2 * pool, filters=filters)
    sparse = sparse_topk_stored(queries, index, 2 * pool, filters=filters)
    return rrf(dense, sparse, pool, **options)


def search_stored(
    queries: DataFrame, index: ChunkIndex, *, top: int = K.SEARCH_TOP, pool: int = K.SEARCH_POOL, filters: Sequence[str] = (), keep: Sequence[str] = (),
    score: Callable[[Column, Column], Column] = query_term_share,
) -> DataFrame:
    """``hybrid_search`` over a stored index: texts and ``keep`` come from its chunks."""
    return rerank(candidates_stored(queries, index, pool, filters), queries, index.chunks(), top, score=score, keep=keep)


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    top: int = K.SEARCH_TOP,
    pool: int = K.SEARCH_POOL,
    filters: Sequence[str] = (),
    keep: Sequence[str] = (),
    score: Callable[[Column, Column], Column] = query_term_share,
) -> DataFrame:
    """``(query_id, rank, chunk_id, text, score, *keep)``.

    ``queries``: query_id, text, embedding and the filter columns; ``chunks``: chunk_id, text,
    embedding, the filter columns and ``keep``. A null filter value on a query matches everything.
    """
    fused = candidates(queries, chunks, pool, filters)
    return rerank(fused, queries, chunks, top, score=score, keep=keep)


def answer_inputs(
    queries: DataFrame, chunks: DataFrame, metadata: Sequence[str], **options
) -> tuple[DataFrame, DataFrame]:
    """Context text and sources per query. The hits feed both, so they are checkpointed."""
    hits = cut_lineage(hybrid_search(queries, chunks, keep=metadata, **options))
    return context(queries, hits), sources(queries, hits, metadata)


def draft_check_context(
    drafts: DataFrame,
    chunks: DataFrame,
    *,
    top: int = K.CHECK_TOP,
    pool: int = K.CHECK_POOL,
    probe_chars: int | None = None,
    passage_chars: int | None = None,
    number: str = "doc_no",
) -> DataFrame:
    """Per draft, the passages of the corpus that it should be read against.

    The whole draft is the probe and whole passages come back, unless a limit is given.
    """
    queries = drafts.withColumn("text", probe("text", probe_chars))
    hits = hybrid_search(queries, chunks, top=top, pool=pool, keep=[number])
    return draft_context(drafts, hits, number=number, passage_chars=passage_chars)
