"""Repair of JSON replies written by an outside extractor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import constants as K
from dossier.functions.text import bound, strip


def _valid(c: Column) -> Column:
    return F.when(F.try_parse_json(c).isNotNull(), c)


def reply_text(c: Column | str) -> Column:
    """The JSON text inside a reply: fences removed, else the widest braces or brackets, else null."""
    c = F.col(c) if isinstance(c, str) else c
    bare = strip(F.regexp_replace(strip(c), K.REPLY_FENCE, ""))
    return bound(
        bare, lambda b: F.coalesce(_valid(b), bound(F.regexp_extract(b, K.REPLY_WIDEST, 0), _valid))
    )


def reply_object_text(c: Column | str) -> Column:
    """The reply as one JSON object: a list stands for its first object, anything else for ``{}``.

    Null only where the reply holds no JSON at all.
    """
    def as_object(text: Column) -> Column:
        first = F.to_json(F.try_variant_get(F.try_parse_json(text), "$[0]", "variant"))
        return (
            F.when(text.isNull() | F.ltrim(text).startswith("{"), text)
            .when(F.ltrim(text).startswith("["), bound(first, lambda f: F.when(f.startswith("{"), f).otherwise("{}")))
            .otherwise(F.lit("{}"))
        )

    return bound(reply_text(c), as_object)


def parse_reply(c: Column | str, schema: str | T.StructType) -> Column:
    """The reply as a struct of ``schema``; unknown keys are dropped, missing ones are null."""
    return F.from_json(reply_object_text(c), schema)
