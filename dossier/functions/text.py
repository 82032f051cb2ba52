"""Text and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import constants as K

# Unicode white space plus the four ASCII separators that Python's str.strip() also removes.
_SPACE = "[\\s\\x1c-\\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Leading and trailing white space removed (Spark's ``trim`` removes blanks only)."""
    return F.regexp_replace(_col(c), f"(?U)^{_SPACE}+|{_SPACE}+\\z", "")


def is_blank(c: Column | str) -> Column:
    return ~_col(c).rlike(f"(?U)[^\\s\\x1c-\\x1f]")


def collapse(c: Column | str) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(_col(c), f"(?U){_SPACE}+", " ")


def strip_nul(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\\x00", "")


def tail(c: Column | str, n: int) -> Column:
    """Last ``n`` code points; ``n = 0`` gives the empty text."""
    c = _col(c)
    if n <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    return F.right(c, F.lit(n))


def excerpt(c: Column | str, head: int = K.HEAD_CHARS, tail_chars: int = K.TAIL_CHARS) -> Column:
    """Struct of the opening and closing part, where the identifying lines stand."""
    c = _col(c)
    return F.struct(F.left(c, F.lit(head)).alias("head"), tail(c, tail_chars).alias("tail"))


def probe(c: Column | str, chars: int | None = K.PROBE_CHARS) -> Column:
    """Search probe: white space collapsed first, then cut; ``None`` keeps the whole text."""
    out = collapse(c)
    return out if chars is None else F.left(out, F.lit(chars))


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits.

    Lower-casing per token is deliberate: a higher-order function is evaluated once per row, where
    a plain expression below an explode would be generated into its inner loop.
    """
    runs = F.regexp_extract_all(_col(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.transform(runs, F.lower)


def safe_name(c: Column | str) -> Column:
    """Characters that file systems refuse become ``_``."""
    return strip(F.regexp_replace(_col(c), '[\\\\/*?:"<>|]', "_"))


def file_extension(c: Column | str) -> Column:
    """Lower-cased extension without the dot, '' if there is none (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(_col(c), "[^/.][^/]*\\.([^./]*)\\z", 1))


def file_stem(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "(?<=[^/.])\\.[^./]*\\z", "")


def twin_key(c: Column | str) -> Column:
    """Name by which a PDF and its Word twin agree: lower case, no extension, no leading ``12_``."""
    return F.regexp_replace(file_stem(F.lower(_col(c))), "^[0-9]+_", "")


def file_kind(ext: Column | str) -> Column:
    ext = _col(ext)
    return (
        F.when(ext.isin(*K.PDF_EXTENSIONS), "pdf")
        .when(ext.isin(*K.SHEET_EXTENSIONS), "sheet")
        .when(ext.isin(*K.WORD_EXTENSIONS), "word")
        .otherwise("other")
    )
