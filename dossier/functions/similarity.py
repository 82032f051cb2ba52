"""Trigram sets and vector similarity as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trigrams(c: Column | str) -> Column:
    """Distinct trigrams of the lower-cased words, each word padded with two blanks and one."""
    words = F.filter(
        F.split(F.lower(_col(c)), "[^\\p{L}\\p{N}]+"), lambda w: w != ""
    )
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_codes(c: Column | str) -> Column:
    """The same set with each trigram as one number made of its three code points."""

    def point(g: Column, i: int) -> Column:
        return F.ascii(F.substring(g, i, 1)).cast("bigint")

    return F.transform(
        trigrams(c),
        lambda g: F.shiftleft(point(g, 1), 42) + F.shiftleft(point(g, 2), 21) + point(g, 3),
    )


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over united trigrams of two trigram sets; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    united = F.size(a) + F.size(b) - shared
    return F.when(united > 0, shared / united).otherwise(F.lit(0.0))


def above(similarity: Column, threshold: float) -> Column:
    """Similarity held in single precision, threshold in double: an exact 2/5 passes 0.4."""
    return similarity.cast("float").cast("double") > F.lit(float(threshold))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two float arrays in double precision; 0 where a vector has no length."""
    a, b = _col(a), _col(b)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
