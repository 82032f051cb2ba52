"""Column functions: each takes Columns (or names) and returns a Column, all inside Catalyst."""

from dossier.functions.dates import normalise_date, sidecar_date
from dossier.functions.replies import parse_reply, reply_object_text, reply_text
from dossier.functions.similarity import cosine, trigram_similarity, trigrams
from dossier.functions.text import (
    collapse,
    content_hash,
    excerpt,
    file_extension,
    file_kind,
    file_stem,
    is_blank,
    probe,
    safe_name,
    strip,
    strip_nul,
    tail,
    tokens,
    twin_key,
)

__all__ = [
    "collapse", "content_hash", "cosine", "excerpt", "file_extension", "file_kind", "file_stem",
    "is_blank", "normalise_date", "parse_reply", "probe", "reply_object_text", "reply_text",
    "safe_name", "sidecar_date", "strip", "strip_nul", "tail", "tokens", "trigram_similarity",
    "trigrams", "twin_key",
]
