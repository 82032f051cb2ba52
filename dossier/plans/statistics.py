"""Corpus statistics and listings over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dossier import constants as K
from dossier.operators.stats import matching, merged, newest
from dossier.sources.store import Store

LISTED = ("doc_id", "doc_no", "issued_on", "subject")


def corpus_stats(store: Store, tags: int = K.TAG_LIST_SIZE) -> DataFrame:
    """``(dimension, value, cnt)`` over all batches, from their counts alone: no document is read.

    Dimensions: ``documents`` and ``chunks`` (value null), ``doc_type``, ``direction``, and the ``tags`` most
    frequent of ``topic``.
    """
    return merged(store.counts(), tags)


def list_documents(store: Store, term: str = "", limit: int | None = K.LISTING_SIZE) -> DataFrame:
    """Newest documents whose number or subject holds the term; the empty term lists all. No text is read."""
    return newest(matching(store.documents().select(*LISTED), term, ["doc_no", "subject"]), "issued_on", "doc_id", limit)
