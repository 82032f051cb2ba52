"""Figures found in documents and totalled per question, with the evidence kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import strip

# A number with its unit: the default pattern of a question.
FIGURE_PATTERN = "([0-9]+(?:[.][0-9]+)?)[ \\t]*([\\p{L}%]*)"
SENTENCE_END = "[.!?]+\\s+|\\n+"
NUMBER = "^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*\\z"


def candidates(questions: DataFrame, docs: DataFrame, max_docs: int | None = None) -> DataFrame:
    """``(question_id, doc_id)`` of the documents that a question's type and dates admit.

    A question with a type joins on it. Those without one (null or ``''``) are a stated set that goes
    to every document as one array value, so no document is copied for questions that do not exist.
    ``max_docs`` keeps the newest ones only, by default all stay. ``truncated`` tells whether more
    documents qualified than were kept.
    """
    q = questions.select("question_id", F.nullif("doc_type", F.lit("")).alias("_scope"), "date_from", "date_to")
    d = docs.select("doc_id", "issued_on", F.col("doc_type").alias("_scope"))
    open_ended = q.where("_scope IS NULL").agg(F.collect_list(F.struct("question_id", "date_from", "date_to")).alias("_all"))
    untyped = d.select("doc_id", "issued_on", F.explode(open_ended.scalar()).alias("_q")).select("doc_id", "issued_on", "_q.*")
    typed = d.join(q, "_scope").select("doc_id", "issued_on", "question_id", "date_from", "date_to")
    pairs = typed.unionByName(untyped).where(
        (F.col("date_from").isNull() | (F.col("issued_on") >= F.col("date_from")))
        & (F.col("date_to").isNull() | (F.col("issued_on") <= F.col("date_to")))
    )
    if max_docs is None:
        return pairs.select("question_id", "doc_id", F.lit(False).alias("truncated"))
    # One row more than is kept shows that the cut applied; both windows hold that many rows at most.
    newest = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("issued_on"), "doc_id")
    return (
        pairs.withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= max_docs + 1)
        .withColumn("truncated", F.max("_rn").over(Window.partitionBy("question_id")) > max_docs)
        .where(F.col("_rn") <= max_docs)
        .select("question_id", "doc_id", "truncated")
    )


def narrow(pairs: DataFrame, hits: DataFrame, above: int = K.NARROW_ABOVE) -> DataFrame:
    """Candidates kept to the documents that keyword retrieval hit; ``narrowed`` tells where that dropped some.

    ``hits``: ``(question_id, doc_id)``, rows only for questions with keywords. A question with
    ``above`` candidates or fewer, or with none left, keeps all of them.
    """
    marked = pairs.join(
        hits.select("question_id", "doc_id").distinct().withColumn("_hit", F.lit(True)),
        ["question_id", "doc_id"],
        "left",
    )
    per_question = marked.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_hit").alias("_kept")
    )
    applies = (F.col("_n") > above) & (F.col("_kept") > 0)
    return (
        marked.join(per_question, "question_id")
        .where(~applies | F.col("_hit").isNotNull())
        .select(*pairs.columns, (applies & (F.col("_kept") < F.col("_n"))).alias("narrowed"))
    )


def sentences(text: Column | str) -> Column:
    parts = F.split(F.col(text) if isinstance(text, str) else text, SENTENCE_END, -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def extract_figures(pairs: DataFrame, questions: DataFrame, docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``(question_id, doc_id, found, value, unit, evidence)``: the first sentence that matches.

    ``questions``: question_id, ``keyword`` (null = any sentence) and ``pattern`` whose first group
    is the value and second the unit. The whole text is read.
    """
    d = docs.select("doc_id", sentences(text).alias("_sentences"))
    q = questions.select("question_id", "pattern", F.lower("keyword").alias("_keyword"))
    rows = pairs.join(d, "doc_id").join(q, "question_id")
    # The first hit ends the work on a text, and no predicate is copied below the explode.
    first = F.expr(
        "aggregate(_sentences, CAST(NULL AS STRING), (hit, s) -> CASE WHEN hit IS NOT NULL THEN hit"
        " WHEN (_keyword IS NULL OR contains(lower(s), _keyword)) AND s RLIKE pattern THEN s END)"
    )
    return rows.select("question_id", "doc_id", "pattern", F.explode(F.array(first)).alias("evidence")).select(
        "question_id",
        "doc_id",
        F.col("evidence").isNotNull().alias("found"),
        F.expr("regexp_extract(evidence, pattern, 1)").alias("value"),
        F.expr("nullif(regexp_extract(evidence, pattern, 2), '')").alias("unit"),
        "evidence",
    )


def matched(figures: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows that count: found ones, and for sums only those whose value is a number or absent.

    Adds ``amount``: 1 per row for counts, the number or 0 for sums.
    """
    q = questions.select("question_id", F.coalesce("agg", F.lit("sum")).alias("agg"))
    number = F.when(F.col("value").rlike(NUMBER), F.expr("try_cast(value AS double)"))
    absent = F.coalesce("value", F.lit("")) == ""
    finite = F.abs(number) != float("inf")
    amount = F.when(F.col("agg") == "count", 1.0).when(absent, 0.0).when(finite, number)
    return (
        figures.where("found").join(q, "question_id").withColumn("amount", amount)
        .where(F.col("amount").isNotNull())
    )


def _exact_total(amount: Column) -> Column:
    """Sum that does not depend on row order: decimals where they fit, doubles for the rest."""
    exact = F.expr("try_cast(value AS decimal(30,10))")
    as_decimal = F.when((F.col("agg") == "count") | (amount == 0), amount.cast("decimal(30,10)")).otherwise(exact)
    rest = F.sum(F.when(as_decimal.isNull(), amount))
    return F.coalesce(F.sum(as_decimal).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def totals(
    questions: DataFrame, pairs: DataFrame, figures: DataFrame
) -> DataFrame:
    """``(question_id, agg, total, n_docs_scanned, n_docs_matched, truncated, narrowed)``, one row per question.

    ``truncated``: more documents qualified than the newest that were taken. ``narrowed``: some
    were left out because the keyword search did not hit them. Either way the total may miss figures.
    """
    flag = lambda c: F.max(c).alias(c) if c in pairs.columns else F.lit(False).alias(c)
    scanned = pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_docs_scanned"), flag("truncated"), flag("narrowed"))
    summed = matched(figures, questions).groupBy("question_id").agg(
        _exact_total(F.col("amount")).alias("total"), F.count(F.lit(1)).alias("n_docs_matched")
    )
    return (
        questions.select("question_id", F.coalesce("agg", F.lit("sum")).alias("agg"))
        .join(scanned, "question_id", "left")
        .join(summed, "question_id", "left")
        .select(
            "question_id",
            "agg",
            F.coalesce("total", F.lit(0.0)).alias("total"),
            F.coalesce("n_docs_scanned", F.lit(0)).cast("long").alias("n_docs_scanned"),
            F.coalesce("n_docs_matched", F.lit(0)).cast("long").alias("n_docs_matched"),
            F.coalesce("truncated", F.lit(False)).alias("truncated"),
            F.coalesce("narrowed", F.lit(False)).alias("narrowed"),
        )
    )


def totals_by_unit(questions: DataFrame, figures: DataFrame) -> DataFrame:
    """The same totals kept apart by unit, since figures of different units do not add up."""
    return matched(figures, questions).groupBy("question_id", "unit").agg(
        _exact_total(F.col("amount")).alias("total"), F.count(F.lit(1)).alias("n_docs_matched")
    )


def evidence(questions: DataFrame, figures: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per matched document: number, date, the raw value, its unit and its sentence."""
    return matched(figures, questions).join(
        docs.select("doc_id", "doc_no", "issued_on"), "doc_id"
    ).select("question_id", "doc_id", "doc_no", "issued_on", "value", "unit", "evidence")
