"""Substring search of many terms at once: character n-grams find candidates, the pattern decides.

A term's literal runs (what stands between its wildcards) give n-grams of three characters, or of
two or one where no run is longer. A row that matches holds all of them, so it is found through the
one that the fewest values hold, and only such rows are compared with the pattern. A term without
any literal character goes by the empty gram, which every value holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.session import written

LONGEST = 3
# What parts literal runs: wildcards, and a backslash with the character it stands before.
BREAKS = r"(?s)\\.|\\$|[%_]"
SPACES = r"[ \t\n\x0B\f\r]+"


def grams(text: Column | str, sizes: Sequence[int] = range(LONGEST + 1)) -> Column:
    """Distinct n-grams of the lower-cased text, for each of ``sizes``; 0 gives the empty gram.

    The text is cut into characters once, so the work is in line with its length.
    """
    text = F.col(text) if isinstance(text, str) else text
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")

    def of(chars: Column, n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        last = F.size(chars) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])))

    # The characters are bound once by a transform over one element.
    cut = F.transform(F.array(chars), lambda c: F.concat(*[of(c, n) for n in sizes]))
    return F.when(text.isNotNull(), F.get(cut, F.lit(0)))


def term_grams(terms: DataFrame, term: str = "term") -> DataFrame:
    """``(term, gram, literal)``: the longest n-grams of each distinct term; ``literal`` if it holds no wildcard or backslash."""
    asked = terms.select(F.col(term).alias("term")).where("term IS NOT NULL").distinct()
    runs = F.split(F.lower("term"), BREAKS, -1)
    longest = F.least(F.array_max(F.transform(runs, F.length)), F.lit(LONGEST))
    of = lambda n: F.array_distinct(F.flatten(F.transform(runs, lambda r: grams(r, [n]))))
    held = F.when(longest == 0, of(0)).when(longest == 1, of(1)).when(longest == 2, of(2)).otherwise(of(3))
    return asked.select("term", F.explode(held).alias("gram"), (~F.col("term").rlike(BREAKS)).alias("literal"))


def match_terms(docs: DataFrame, terms: DataFrame, columns: Sequence[str], *, id_column: str = "doc_id", term: str = "term") -> DataFrame:
    """``(term, id)`` of every row in which any of ``columns`` holds the term, case ignored.

    ``%`` and ``_`` in a term are wildcards unless a backslash stands before them; the empty term finds every row
    with a value. Null terms and null values find nothing. Rows are told apart by ``id_column``;
    one row comes for each distinct term and id. Each distinct value is searched once, however many rows hold it, and
    is shuffled only under n-grams that some term asks for. Intermediate tables are written, because a table
    of n-grams planned on its estimate would be broadcast.
    """
    wanted = written(term_grams(terms, term), "term-grams")
    values = docs.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in columns]))).alias("value")).where("value IS NOT NULL")
    values = values.withColumn("digest", F.unhex(F.sha2("value", 256)))
    texts = written(values.groupBy("digest").agg(F.min("value").alias("value")).withColumn("at", F.monotonically_increasing_id()), "values")
    held = written(texts.select("at", F.explode(grams("value")).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"), "held-grams")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no value holds rules its term out.
    rarest = wanted.join(counts, "gram", "left").groupBy("term", "literal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    keys = written(rarest.where("best.n > 0").select("term", "literal", F.col("best.gram").alias("gram")), "keys")
    met = held.join(keys, "gram").select("at", "term", "literal").join(texts.select("at", "value"), "at")
    # A backslash before a plain character means that character; ILIKE would refuse it.
    pattern = F.concat(F.lit("%"), F.regexp_replace("term", r"(\\[%_\\])|\\(?=.)", "$1"), F.lit("%"))
    fits = F.when(F.col("literal"), F.contains(F.lower("value"), F.lower("term"))).otherwise(F.expr("value ILIKE pattern"))
    found = written(met.withColumn("pattern", pattern).where(fits).select("term", "at"), "found")
    placed = values.select("id", "digest").join(texts.select("digest", "at"), "digest").select("id", "at")
    return placed.join(found, "at").select("term", "id").distinct()


def newest_per_term(
    docs: DataFrame, terms: DataFrame, columns: Sequence[str], *, date_column: str, id_column: str = "doc_id", term: str = "term",
    limit: int = K.LISTING_SIZE, keep: Sequence[str] = (),
) -> DataFrame:
    """The newest ``limit`` hits of each term: ``(term, id_column, date_column, *keep, hit_rank)``; undated last, ties by id.

    A term without wildcard and white space stands in a row where it stands in one of its words. Such terms
    are searched in the distinct words, each word keeps its newest ``limit`` rows, and a term's list is
    chosen from those of its words; so the work is in line with the text and not with the hits. The other
    terms are searched in the whole values.
    """
    rows = written(docs.select(F.col(id_column).alias("_id"), F.col(date_column).alias("_date"), *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)],
                               *[F.col(c).alias(f"_k_{c}") for c in keep], F.monotonically_increasing_id().alias("_row")), "rows")
    cells = [f"_c{i}" for i in range(len(columns))]
    asked = terms.select(F.col(term).alias("term")).where("term IS NOT NULL").distinct()
    one_word = ~F.col("term").rlike(BREAKS) & ~F.lower("term").rlike(SPACES) & (F.col("term") != "")
    asked = written(asked.withColumn("one_word", one_word), "terms")

    words = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.split(F.lower(c), SPACES), F.array().cast("array<string>")) for c in cells])))
    said = rows.select("_row", "_id", "_date", F.explode(words).alias("word")).where("word <> ''")
    vocabulary = written(said.select("word").distinct(), "vocabulary")
    holding = written(match_terms(vocabulary, asked.where("one_word"), ["word"], id_column="word").withColumnRenamed("id", "word"), "holding")
    newest = lambda key: Window.partitionBy(key).orderBy(F.desc_nulls_last("_date"), F.asc("_id"), "_row")
    of_word = said.join(holding.select("word").distinct(), "word", "left_semi").withColumn("_rn", F.row_number().over(newest("word"))).where(F.col("_rn") <= limit)
    # Read once per term that a word holds, hence written.
    hits = written(of_word.drop("_rn"), "newest-of-words").join(holding, "word").select("term", "_row", "_id", "_date").distinct()
    others = asked.where("NOT one_word")
    if not others.isEmpty():
        whole = match_terms(rows, others, cells, id_column="_row").withColumnRenamed("id", "_row")
        hits = hits.unionByName(whole.join(rows.select("_row", "_id", "_date"), "_row"))
    best = hits.withColumn("hit_rank", F.row_number().over(newest("term"))).where(F.col("hit_rank") <= limit)
    if keep:
        best = best.join(rows.select("_row", *[F.col(f"_k_{c}").alias(c) for c in keep]), "_row")
    return best.select("term", F.col("_id").alias(id_column), F.col("_date").alias(date_column), *keep, "hit_rank")
