"""Quality rules, lines first: lines that fail a rule go, then documents that lost too much of their text.

Everything is an expression over one row: a text is cut into lines and words once, repeated windows
are found by sorting the row's own windows. Nothing is shuffled and no row is exploded, so neither a
hot source nor a very long text makes a task heavier than its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, symbols, and the base rules' limits.
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
LEAST_WORDS, WINDOW, REPEAT_SHARE = 50, 3, 50

# A line of prose ends with one of these marks, or holds a word with such an end for every PROSE_WORDS words.
PROSE_WORDS = 25
END_MARKS = tuple(".!?:;…\"')]}»”’。！？：；」』）")
# Words that part the entries of a menu or a path; a line is navigation if one word in NAV_SHARE is such a mark.
NAV_MARKS, NAV_SHARE = ("|", "||", ">", ">>", "»", "›", "·", "•", "/", "::", "→", "←"), 4
# Symbols a line may hold per hundred words, and words ending in repeated marks.
SYMBOL_SHARE, SHOUT_SHARE, SHOUTS = 50, 30, ("!!", "??", "?!", "!?")
# A line of at most BOILER_WORDS words that holds one of these phrases is boilerplate.
BOILER_WORDS = 40
BOILERPLATE = (
    "all rights reserved", "accept cookies", "use of cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "lorem ipsum", "click here", "read more", "sign in", "log in", "subscribe to our", "share this", "skip to content", "powered by",
)
# A document is rejected if its failed lines hold more than this share of its words (percent).
LOST_SHARE = 50


def line_fails(words: Column, n_symbols: Column, phrases: Column) -> Column:
    """Whether a line with at least one word fails a punctuation, navigation or boilerplate rule.

    ``phrases`` holds the line, lower-cased, where it is short enough to be boilerplate.
    """
    n = F.size(words)
    ends = lambda w: F.right(w, F.lit(1)).isin(*END_MARKS)
    n_marks = F.size(F.filter(words, lambda w: w.isin(*NAV_MARKS)))
    shouts = lambda w: reduce(Column.__or__, [F.endswith(w, F.lit(mark)) for mark in SHOUTS])
    boiler = reduce(Column.__or__, [phrases.contains(phrase) for phrase in BOILERPLATE])
    return (
        (~ends(F.get(words, n - 1)) & (PROSE_WORDS * F.size(F.filter(words, ends)) < n))
        | (NAV_SHARE * n_marks >= n)
        | (100 * n_symbols > SYMBOL_SHARE * n)
        | (100 * F.size(F.filter(words, shouts)) >= SHOUT_SHARE * n)
        | F.coalesce(boiler, F.lit(False))
    )


def _windows(words: str) -> Column:
    """Every run of three words with its place, as structs; null where there are fewer words."""
    n = F.size(words) - (WINDOW - 1)
    part = lambda k: F.slice(words, k, F.greatest(n, F.lit(0)))
    return F.when(n > 0, F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.sequence(F.lit(0), n - 1).alias("i")))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda x, y: x + y)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, the whole row as a struct, with the measures of its text and the lines that stay.

    Null text counts as empty: no words, no lines, base failed. Ties and repeated rows are rows like
    others. All columns of ``docs`` are inside ``row``, so their names clash with nothing.
    """
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = F.transform(F.split("text", "\n"), lambda x: F.struct(
        x.alias("line"), F.regexp_extract_all(x, F.lit(WORD), F.lit(0)).alias("words"), F.regexp_count(x, F.lit(SYMBOL)).alias("symbols"),
    ))
    lower = lambda x: F.when(F.size(x["words"]) <= BOILER_WORDS, F.lower(x["line"]))
    parted = named.select("row", F.filter(cut, lambda x: F.size(x["words"]) > 0).alias("lines")).withColumn("short", F.transform("lines", lower))
    judged = parted.select(
        "row", F.col("lines.line").alias("lines"), F.flatten("lines.words").alias("words"), _total(F.transform("lines.symbols", lambda n: n.cast("long"))).alias("n_symbols"),
        F.transform("lines", lambda x, i: F.when(line_fails(x["words"], x["symbols"], F.get("short", i)), F.size(x["words"])).otherwise(F.lit(0))).alias("lost"),
    )
    # Sorted windows: equal ones are neighbours.
    counted = judged.select(
        "row", "lines", "lost", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.sort_array(_windows("words")).alias("windows"),
    )
    next_to = F.greatest(F.size("windows") - 1, F.lit(0))
    beside = F.arrays_zip(F.slice("windows", 1, next_to).alias("x"), F.slice("windows", 2, next_to).alias("y"))
    twice = F.filter(beside, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    paired = counted.select("*", twice.alias("twice")).drop("windows")
    found = paired.select("*", F.sort_array(F.array_distinct(F.flatten(F.array("twice.x.i", "twice.y.i")))).alias("at")).drop("twice")
    covers = F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW))).cast("long"))
    return found.select(
        "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_total(covers), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lost", lambda n: n > 0)).cast("long").alias("n_failed_lines"),
        F.coalesce(_total(F.transform("lost", lambda n: n.cast("long"))), F.lit(0).cast("long")).alias("n_lost_words"),
        F.array_join(F.filter("lines", lambda x, i: F.get("lost", i) == 0), "\n").alias("clean_text"),
    )


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    rows = measured(docs, text_col)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    lost = 100 * F.col("n_lost_words") > LOST_SHARE * F.col("n_words")
    return rows.select("*", base.alias("base_failed"), (~base & ~lost).alias("kept"))


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns, with the failed lines taken out of their text."""
    rows = judged(docs, text_col).where("kept")
    return rows.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
