"""Incremental jobs."""

from dossier.streaming.ingest import ingest_landing

__all__ = ["ingest_landing"]
