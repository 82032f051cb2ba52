"""Normalisation of document metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.dates import normalise_date, sidecar_date
from dossier.functions.text import strip

REPLY_SCHEMA = (
    "doc_no string, issued_on string, doc_type string, type_code string, issuer string,"
    " signer string, signer_title string, subject string, role string,"
    " policies array<string>, fields array<string>, topics array<string>"
)


def doc_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.DOC_TYPES, "doc_type string, type_code string")


def code_in_number(doc_no: Column | str) -> Column:
    """Letters after the first ``/`` or ``-`` of a document number, in upper case; null if none."""
    doc_no = F.col(doc_no) if isinstance(doc_no, str) else doc_no
    return F.nullif(F.upper(F.regexp_extract(doc_no, K.TYPE_IN_NUMBER, 1)), F.lit(""))


def resolve_type(
    docs: DataFrame, types: DataFrame, *, given: str = "doc_type", code: str = "type_code",
    number: str = "doc_no",
) -> DataFrame:
    """``doc_type`` by given type, else by its code, else by the number, else the fallback; then
    ``type_code`` rewritten from the type.

    ``types`` is the fixed table of 30 rows, hence the hint.
    """
    coded = types.where(F.col("type_code") != "")
    by_name = F.broadcast(types.select(F.col("doc_type").alias("_given"), F.lit(True).alias("_ok")))
    by_code = F.broadcast(
        coded.select(F.col("type_code").alias("_code"), F.col("doc_type").alias("_by_code"))
    )
    by_number = F.broadcast(
        coded.select(
            F.upper("type_code").alias("_in_number"), F.col("doc_type").alias("_by_number")
        )
    )
    back = F.broadcast(
        types.select(F.col("doc_type").alias("_type"), F.col("type_code").alias("_type_code"))
    )
    resolved = F.coalesce(
        F.when(F.col("_ok"), F.col(given)), "_by_code", "_by_number", F.lit(K.FALLBACK_TYPE)
    )
    keep = [c for c in docs.columns if c not in ("doc_type", "type_code")]
    return (
        docs.join(by_name, F.col(given) == F.col("_given"), "left")
        .join(by_code, F.col(code) == F.col("_code"), "left")
        .join(by_number, code_in_number(number) == F.col("_in_number"), "left")
        .select(*keep, resolved.alias("doc_type"))
        .join(back, F.col("doc_type") == F.col("_type"), "left")
        .select(*keep, "doc_type", F.coalesce("_type_code", F.lit("")).alias("type_code"))
    )


def _no_empties(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def _or_empty(values: Column | str) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return F.coalesce(values, F.array().cast("array<string>"))


def clean_list(values: Column | str) -> Column:
    """Empty members dropped, the rest stripped."""
    return F.transform(_no_empties(_or_empty(values)), strip)


def clean_topics(values: Column | str, limit: int = K.TOPIC_LIMIT) -> Column:
    """First ``limit`` members; the cut comes before empty ones are dropped."""
    return clean_list(F.slice(_or_empty(values), 1, limit))


def clean_fields(values: Column | str, allowed: Sequence[str] = K.FIELD_VALUES) -> Column:
    """Members of the fixed list, in their order."""
    return F.filter(_or_empty(values), lambda v: F.coalesce(v.isin(*allowed), F.lit(False)))


def clean_role(
    role: Column | str, allowed: Sequence[str] = K.ROLE_VALUES, fallback: str = K.FALLBACK_ROLE
) -> Column:
    role = F.col(role) if isinstance(role, str) else role
    return F.when(role.isin(*allowed), role).otherwise(F.lit(fallback))


def fill_gap(extracted: Column | str, sidecar: Column | str) -> Column:
    """The extracted value, else the sidecar's unless that is empty or ``N/A``."""
    extracted = F.col(extracted) if isinstance(extracted, str) else extracted
    sidecar = F.col(sidecar) if isinstance(sidecar, str) else sidecar
    usable = F.nullif(F.nullif(sidecar, F.lit("")), F.lit("N/A"))
    return F.coalesce(F.nullif(extracted, F.lit("")), usable, extracted)


def lock_values(docs: DataFrame) -> DataFrame:
    """Sidecar values that override extracted ones.

    Takes extracted ``doc_no, issued_on, subject, issuer`` and their ``side_`` counterparts, all
    text. A number or subject present in the sidecar wins even when empty; the issuer wins only
    when it is not. ``issued_on`` stays text here.
    """
    filled_date = normalise_date(fill_gap("issued_on", "side_issued_on")).cast("string")
    locked = {
        "doc_no": F.coalesce("side_doc_no", fill_gap("doc_no", "side_doc_no")),
        "subject": F.coalesce("side_subject", fill_gap("subject", "side_subject")),
        "issued_on": sidecar_date("side_issued_on", filled_date),
        "issuer": F.coalesce(F.nullif("side_issuer", F.lit("")), "issuer"),
    }
    return docs.withColumns(locked)


def normalise(docs: DataFrame, types: DataFrame) -> DataFrame:
    """Extracted reply columns of ``REPLY_SCHEMA`` plus ``side_`` columns to final metadata.

    The type is resolved from the number as filled from the sidecar, before the locks.
    """
    number = fill_gap("doc_no", "side_doc_no")
    typed = resolve_type(docs.withColumn("_number", number), types, number="_number").drop("_number")
    return lock_values(typed).withColumns(
        {
            "policies": clean_list("policies"),
            "fields": clean_fields("fields"),
            "topics": clean_topics("topics"),
            "role": clean_role("role"),
            "issued_on": F.try_to_date("issued_on", "yyyy-MM-dd"),
        }
    )
