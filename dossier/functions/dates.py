"""Date spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import strip


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date from three digit texts, null when they name no day."""
    text = F.concat_ws("-", year, month, day)
    return F.try_to_date(F.when(year != "", text), "yyyy-M-d")


def normalise_date(c: Column | str) -> Column:
    """``2024-3-5`` as a whole, else the first ``5/3/2024`` or ``5-3-2024`` inside; else null."""
    c = F.col(c) if isinstance(c, str) else c
    iso = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\\z"
    dmy = "([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
    as_iso = _date(*(F.regexp_extract(c, iso, i) for i in (1, 2, 3)))
    as_dmy = _date(*(F.regexp_extract(c, dmy, i) for i in (3, 2, 1)))
    return F.coalesce(as_iso, as_dmy)


def sidecar_date(raw: Column | str, fallback: Column | str) -> Column:
    """Date text that overrides the extracted one.

    ``d/m/y`` is reordered and padded, another text without a slash is taken as it is, and a text
    with a slash that has not three parts leaves the fallback in place.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    fallback = F.col(fallback) if isinstance(fallback, str) else fallback
    parts = F.split(raw, "/")

    def pad(i: int) -> Column:
        part = strip(F.get(parts, F.lit(i)))
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    ordered = F.concat_ws("-", strip(F.get(parts, F.lit(2))), pad(1), pad(0))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", fallback)
        .when(raw.contains("/"), F.when(F.size(parts) == 3, ordered).otherwise(fallback))
        .otherwise(raw)
    )
