"""Lexical ranking: BM25 weights as a long table, scored by an equi join on the term."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import bound, tokens
from dossier.session import written

SCORE_DIGITS = 9
# Pairs of chunk and query that one task sums up in memory, and (query, term) rows that travel to every task at once.
PAIRS, QUERY_TERMS = 1 << 19, 1 << 20
# Stands for the chunk itself among its terms; no term is empty.
NO_TERM = ""


def _counted(rows: DataFrame, row_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(row_id, *keep, dl, terms)``: the row's length in terms, and each distinct term with its occurrences.

    Counting sorts the terms inside the row, so an occurrence is never a row of its own.
    """

    def runs(t: Column) -> Column:
        last = F.size(t) - 1
        first = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        of = lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), last + 1) - i).alias("tf")))
        return F.when(last >= 0, bound(first, of))

    toks = rows.select(row_id, *keep, F.array_sort(tokens(text)).alias("_t"))
    return toks.select(row_id, *keep, F.size("_t").alias("dl"), bound(F.col("_t"), runs).alias("terms"))


def _flat(counted: DataFrame, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(row_id, *keep, dl, term, tf)`` of rows that lie together by ``row_id``; equal rows of one id are added."""
    flat = counted.select(row_id, *keep, "dl", F.inline("terms"))
    return flat.groupBy(row_id, *keep, "dl", "term").agg(F.sum("tf").alias("tf"))


def _held(chunks: DataFrame, wanted: DataFrame | None, row_id: str, text: str, keep: Sequence[str]) -> DataFrame:
    """``(row_id, *keep, dl, term, tf)``, written: a row of the term ``NO_TERM`` per chunk, and its counts of the terms in ``wanted`` (null: of all)."""
    counted = _counted(chunks, row_id, text, keep)
    none = F.array(F.struct(F.lit(NO_TERM).alias("term"), F.lit(0).alias("tf")))
    flat = counted.select(row_id, *keep, "dl", F.inline(F.concat(none, F.coalesce("terms", F.slice(none, 1, 0)))))
    if wanted is not None:
        flat = flat.join(F.broadcast(wanted.union(wanted.sparkSession.range(1).select(F.lit(NO_TERM)))), "term", "left_semi")
    return written(flat.select(row_id, *keep, "dl", "term", "tf"), "counted")


def term_counts(rows: DataFrame, row_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(row_id, dl, term, tf)``: occurrences of each term and the row's length in terms."""
    return _flat(_counted(rows, row_id, text, keep).repartition(row_id), row_id, keep)


def _document_weight(avg_dl: Column, k1: float, b: float) -> Column:
    tf = F.col("tf").cast("double")
    return tf * (k1 + 1) / (tf + k1 * (F.lit(1 - b) + F.lit(b) * F.col("dl") / avg_dl))


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def sparse_weights(
    chunks: DataFrame, *, chunk_id: str = "chunk_id", text: str = "text",
    k1: float = K.BM25_K1, b: float = K.BM25_B,
) -> DataFrame:
    """The stored form: ``(chunk_id, term, weight)`` with weight > 0, idf included."""
    counted = written(_counted(chunks, chunk_id, text), "counted")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))
    # Only rows of one id must lie together to be added, and few are; the others stay where they are.
    many = written(counted.groupBy(F.col(chunk_id).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"), "repeated-ids")
    same = F.col(chunk_id).eqNullSafe(F.col("_id"))
    lone = counted.join(many, same, "left_anti").select(chunk_id, "dl", F.inline("terms")).withColumn("tf", F.col("tf").cast("long"))
    counts = lone.unionByName(_flat(counted.join(many, same, "left_semi").repartition(chunk_id), chunk_id))
    df = written(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    n, avg_dl = stats.select("n").scalar(), stats.select("avg_dl").scalar()
    weight = _idf(n, F.col("df")) * _document_weight(avg_dl, k1, b)
    return counts.join(df, "term").select(chunk_id, "term", weight.alias("weight"))


def sparse_topk(
    queries: DataFrame,
    chunks: DataFrame,
    n: int,
    *,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    text: str = "text",
    query_text: str = "text",
    filters: Sequence[str] = (),
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
) -> DataFrame:
    """``(query_id, chunk_id, sparse_score, sparse_rank)``: best ``n`` chunks sharing a term.

    A query's filter that is null or ``''`` is absent. The chunks' counts of the terms asked for are written once
    and dealt by chunk to so many tasks that each meets at most about ``PAIRS`` pairs of chunk and query; that
    exchange carries frequencies and scores. The queries are a stated set: their terms and weights go to the tasks,
    the weights in blocks of at most ``QUERY_TERMS`` rows (of several blocks, counts of all terms are written), so
    counts are not shuffled by term, and the per-query cut is applied in each task before the exchange by query.
    """
    queries = queries.withColumns({f: F.nullif(F.col(f), F.lit("")) for f in filters})
    q_counts = written(term_counts(queries, query_id, query_text, filters).withColumnRenamed("tf", "qtf"), "query-terms")
    asked = q_counts.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct(query_id).alias("queries")).first()
    blocks = max(1, -(-asked["terms"] // QUERY_TERMS))
    held = _held(chunks, q_counts.select("term").distinct() if blocks == 1 else None, chunk_id, text, filters)
    stats = held.where(F.col("term") == NO_TERM).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl")).first()
    total, avg_dl = F.lit(stats["n"]), F.lit(stats["avg_dl"]).cast("double")
    width = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(width, -(-stats["n"] * asked["queries"] // PAIRS))
    of_block = lambda i: q_counts.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i) if blocks > 1 else q_counts
    dealt = held.where(F.col("term") != NO_TERM).repartition(width, chunk_id)

    def scored(q_counts: DataFrame) -> DataFrame:
        wanted = F.broadcast(q_counts.select("term").distinct())
        found = dealt.join(wanted, "term", "left_semi")
        counts = found.groupBy(chunk_id, *filters, "dl", "term").agg(F.sum("tf").alias("tf"))
        # tf is never null; naming it keeps both uses of the exchange alike, so that it runs once.
        df = counts.groupBy("term").agg(F.count("tf").alias("df"))
        q_weights = q_counts.join(df, "term").select(
            query_id,
            "term",
            *[F.col(f).alias(f"_q_{f}") for f in filters],
            (F.col("qtf") * _idf(total, F.col("df"))).alias("q_weight"),
        )
        pairs = counts.withColumn("c_weight", _document_weight(avg_dl, k1, b)).join(F.broadcast(q_weights), "term")
        for f in filters:
            pairs = pairs.where(F.col(f"_q_{f}").isNull() | (F.col(f"_q_{f}") == F.col(f)))
        # Sums of doubles differ in the last bits with their order, hence the rounding before ranking.
        return pairs.groupBy(query_id, chunk_id).agg(
            F.round(F.sum(F.col("q_weight") * F.col("c_weight")), SCORE_DIGITS).alias("sparse_score")
        )

    every = reduce(DataFrame.unionByName, [scored(of_block(i)) for i in range(blocks)])
    order = Window.partitionBy(query_id).orderBy(F.desc("sparse_score"), F.asc(chunk_id))
    return every.withColumn("sparse_rank", F.row_number().over(order)).where(
        F.col("sparse_rank") <= n
    )
