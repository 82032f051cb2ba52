"""Best fuzzy matches of many probe texts in a corpus of short texts, by trigram similarity.

An exact top-n set-similarity join over distinct trigram sets. The trigrams of a set stand in the
order of their true frequency in the corpus, rarest first. Two sets of sizes a and b whose Jaccard
value reaches t share at least o = t / (1 + t) * (a + b) trigrams, hence one of the first a - o + 1 of
the one and b - o + 1 of the other, and what can still follow their first common trigram bounds the
rest. The value t is each probe's own: a first look at a few texts for its rarest trigrams gives a
value that its n-th best match reaches at least, so a probe with near matches looks at few of its
trigrams, the rarest. Only a probe without such matches goes down to the given threshold.

Each set also has a bitmap of its hashed trigrams. Trigrams that only one of two sets holds set at least
as many bits as the bitmaps differ in, so sets that differ in too many are left out before they are compared.
The rows that meet by a trigram hold sizes, places and bitmaps only; the sets themselves are met by the pairs
that are left, once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.similarity import above, trigram_codes
from dossier.functions.text import bound
from dossier.session import cut_lineage

# The first look: so many of a probe's rarest trigrams, and so many texts of one size or with the same frequent trigrams
# (each in one of so many sets) for each. It only sets where the full search of a probe begins; no match is left out by it.
LOOK_GRAMS, LOOK_TEXTS, FREQUENT = 8, 32, 32
# Slightly below a bound, so that rounding never loses a pair at it.
SLACK = 1e-6
# Words of 64 bits in a set's bitmap.
WORDS = 4
# A trigram of more texts is dealt into several keys of the join; texts that hold it at places further apart have keys of their own.
GRAM_ROWS, PLACES = 1 << 16, 4


def _sets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(value, node)`` of distinct texts and ``(node, grams)`` of distinct sets, each named by its smallest text.

    A text without trigrams matches nothing.
    """
    each = cut_lineage(texts.where(F.col("value").isNotNull()).distinct().select("value", F.array_sort(trigram_codes("value")).alias("grams")).where(F.size("grams") > 0))
    heads = each.groupBy("grams").agg(F.min("value").alias("node"))
    return each.join(heads, "grams").select("value", "node"), heads


def _bitmap(grams: Column) -> Column:
    bit = lambda g: F.pmod(F.xxhash64(g), F.lit(64 * WORDS)).cast("int")
    word = lambda w: F.transform(F.filter(grams, lambda g: F.floor(bit(g) / 64) == w), lambda g: F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(g) % 64))
    return F.struct(*[F.aggregate(word(w), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y)).alias(f"w{w}") for w in range(WORDS)])


def _words(bits: str, side: str) -> list[Column]:
    return [F.col(bits)[f"w{w}"].alias(f"{side}{w}") for w in range(WORDS)]


def _differ(left: list[Column], right: list[Column]) -> Column:
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right, strict=True)]
    return sum(differ[1:], differ[0])


def most_shared(left: str, right: str, a: Column, b: Column) -> Column:
    """A number that the trigrams shared by two sets of these sizes and bitmaps do not exceed."""
    return (a + b - _differ(_words(left, "l"), _words(right, "r"))) / 2


def _ordered(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """``(id, node, size, grams, counts, known, bits)``: trigrams rarest first; ``known`` of them stand in the corpus, in ``counts`` sets each, behind the others."""
    flat = sets.select("node", F.explode("grams").alias("gram")).join(counts, "gram", "left")
    keyed = flat.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("keyed"))
    rows = keyed.select(
        "node", F.size("keyed").alias("size"), F.transform("keyed", lambda x: x["gram"]).alias("grams"), F.transform("keyed", lambda x: x["n"]).alias("counts"),
        F.size(F.filter("keyed", lambda x: x["n"] > 0)).alias("known"),
    ).withColumn("bits", _bitmap(F.col("grams")))
    # The rows lie in the shared folder, so each use of them has the same numbers.
    return cut_lineage(rows).withColumn("id", F.monotonically_increasing_id())


def trigram_tables(probes: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts and ordered sets of both sides; inputs have ``value``."""
    left_texts, left = _sets(probes)
    right_texts, right = _sets(corpus)
    right = cut_lineage(right)
    counts = right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return left_texts, _ordered(left, counts), right_texts, _ordered(right, counts)


def _similarity(left: str, right: str) -> Column:
    """Of two sets; the trigrams they share are counted once."""
    return bound(F.size(F.array_intersect(left, right)), lambda shared: shared / (F.size(left) + F.size(right) - shared))


def _apart() -> Column:
    """Bits in which the bitmaps of a row differ."""
    return _differ([F.col(f"l{w}") for w in range(WORDS)], [F.col(f"r{w}") for w in range(WORDS)])


def _met(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` of ``(left_id, right_id)`` with the columns of ``left`` and the other set's ``right_node`` and ``right_grams``."""
    held = right.select(F.col("id").alias("right_id"), F.col("node").alias("right_node"), F.col("grams").alias("right_grams"))
    return pairs.join(left, "left_id").join(held, "right_id")


def _floors(near: DataFrame, left: DataFrame, right: DataFrame, top: int, skip_equal: bool) -> DataFrame:
    """``(left_node, floor)`` from the pairs ``(left_id, right_id, apart)`` whose bitmaps are nearest; a pair may come more than once and has one rank."""
    nearest = Window.partitionBy("left_id").orderBy("apart", "right_id")
    chosen = near.withColumn("_rn", F.dense_rank().over(nearest)).where(F.col("_rn") <= 2 * top + 1).groupBy("left_id", "right_id").agg(F.lit(1)).select("left_id", "right_id")
    met = _met(chosen, left.select(F.col("id").alias("left_id"), F.col("node").alias("left_node"), F.col("grams").alias("left_grams")), right)
    if skip_equal:
        met = met.where("left_node <> right_node")
    order = Window.partitionBy("left_node").orderBy(F.desc("similarity"), "right_node")
    best = met.select("left_node", "right_node", _similarity("left_grams", "right_grams").alias("similarity")).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top)
    return best.groupBy("left_node").agg(F.min("similarity").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == top).drop("n")


def first_look(left: DataFrame, right: DataFrame, top: int, skip_equal: bool) -> DataFrame:
    """``(left_node, floor)``: a similarity that the ``top`` best matches of a probe reach at least.

    Each probe meets a bounded number of texts of its rarest trigrams, those that have its size and those that
    have the same frequent trigrams, and is compared with the nearest by their bitmaps; a probe that meets too few has no row.
    """
    frequent = right.count() / FREQUENT
    same = F.xxhash64(F.filter("grams", lambda _, i: F.get("counts", i) >= frequent))
    alike = F.explode(F.array(F.col("size").cast("bigint"), same)).alias("alike")
    rarest = F.slice("grams", F.col("size") - F.col("known") + 1, F.lit(LOOK_GRAMS))
    asked = left.select(F.col("id").alias("left_id"), F.col("size").alias("left_size"), *_words("bits", "l"), rarest.alias("grams"), alike).withColumn("gram", F.explode("grams")).drop("grams")
    few = Window.partitionBy("gram", "alike").orderBy(F.xxhash64("gram", "right_id"), "right_id")
    held = right.select(F.col("id").alias("right_id"), F.col("size").alias("right_size"), *_words("bits", "r"), "grams", alike).withColumn("gram", F.explode("grams")).drop("grams")
    held = held.withColumn("_rn", F.row_number().over(few)).where(F.col("_rn") <= LOOK_TEXTS).drop("_rn")
    near = asked.join(held, ["gram", "alike"]).select("left_id", "right_id", (_apart() / (F.col("left_size") + F.col("right_size"))).alias("apart"))
    return _floors(near, left, right, top, skip_equal)


def second_look(left: DataFrame, right: DataFrame, floors: DataFrame, threshold: float, top: int, skip_equal: bool) -> DataFrame:
    """The floors, raised by comparing each probe with the nearest by their bitmaps of all texts that it may match.

    Each task passes on a probe's nearest only, so the search that follows compares few pairs that are not in its result.
    """
    probes = cut_lineage(_probes(left, floors, threshold))
    found = _floors(near_pairs(probes, right, threshold), left, right, top, skip_equal)
    return floors.unionByName(found).groupBy("left_node").agg(F.max("floor").alias("floor"))


def _probes(left: DataFrame, floors: DataFrame, threshold: float) -> DataFrame:
    least = F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(threshold)) - SLACK
    return left.join(floors, F.col("node") == F.col("left_node"), "left").select(
        F.col("id").alias("left_id"), F.col("node").alias("left_node"), F.col("size").alias("left_size"), F.col("grams").alias("left_grams"), "counts", *_words("bits", "l"), least.alias("least"),
    )


def near_pairs(probes: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(left_id, right_id, apart)``: pairs whose sizes, common trigram and bitmaps allow the probe's ``least`` similarity.

    A pair comes once for each such trigram. ``apart``: share of the trigrams that the bitmaps tell apart.
    """
    a, b, t = F.col("left_size"), F.col("size"), F.col("least")
    keys = F.greatest(F.ceil(F.col("count") / GRAM_ROWS), F.lit(1)).cast("int")
    sized = probes.select("*", F.explode(F.sequence(F.ceil(a * t).cast("int"), F.floor(a / t).cast("int"))).alias("size"))
    sized = sized.withColumn("overlap", F.ceil((a + b) * (t / (1 + t))).cast("int"))
    probing = sized.select(
        "left_id", "size", (b - F.col("overlap")).alias("last"), (a + b - 2 * F.col("overlap")).alias("room"), (a + b).alias("both"), *[f"l{w}" for w in range(WORDS)], "counts",
        F.posexplode(F.slice("left_grams", F.lit(1), F.greatest(a - F.col("overlap") + 1, F.lit(0)))).alias("i", "gram"),
    ).withColumn("count", F.get("counts", F.col("i"))).drop("counts", "i").where("count > 0")
    reached = F.floor(F.greatest(F.col("last"), F.lit(0)) / PLACES).cast("int") + 1
    probing = probing.select("*", F.explode(F.sequence(F.lit(0), keys * reached - 1)).alias("key")).drop("count")
    longest = b - F.ceil(b * F.lit(threshold - SLACK)).cast("int") + 1
    indexed = right.select("size", F.col("id").alias("right_id"), *_words("bits", "r"), "counts", F.posexplode(F.slice("grams", F.lit(1), longest)).alias("j", "gram"))
    indexed = indexed.withColumn("count", F.get("counts", F.col("j"))).withColumn("key", F.floor(F.col("j") / PLACES).cast("int") * keys + F.pmod(F.xxhash64("right_id"), keys).cast("int")).drop("counts", "count")
    met = probing.join(indexed, ["gram", "size", "key"]).where((F.col("j") <= F.col("last")) & (_apart() <= F.col("room")))
    return met.select("left_id", "right_id", (_apart() / F.col("both")).alias("apart"))


def similar_sets(left: DataFrame, right: DataFrame, floors: DataFrame, threshold: float) -> DataFrame:
    """``(left_node, right_node, similarity)`` of all pairs above the threshold and not below the probe's floor."""
    probes = cut_lineage(_probes(left, floors, threshold))
    # Dealt by probe, where each pair is kept once and then meets the probe's set without another exchange.
    pairs = near_pairs(probes, right, threshold).select("left_id", "right_id").repartition("left_id").groupBy("left_id", "right_id").agg(F.lit(1)).select("left_id", "right_id")
    met = _met(pairs, probes.select("left_id", "left_node", "left_grams", "least"), right)
    # Compared in a generator, which no filter copies.
    kept = F.filter(F.array(_similarity("left_grams", "right_grams")), lambda s: (s >= F.col("least")) & above(s, threshold))
    return met.select("left_node", "right_node", F.explode(kept).alias("similarity"))


def fuzzy_topk(
    probes: DataFrame,
    corpus: DataFrame,
    *,
    probe: str = "probe",
    key: str = "doc_no",
    corpus_id: str = "doc_id",
    threshold: float = K.FUZZY_THRESHOLD,
    top: int = K.FUZZY_TOP,
    skip_equal: bool = False,
) -> DataFrame:
    """``(probe, match_id, match, similarity, match_rank)``: best ``top`` rows per distinct probe.

    Equal similarities are ordered by id. Only the ``top`` smallest ids of a corpus text, and twice
    as many of a set, can reach a result, so a text or set of any size adds at most that many.
    """
    if not 0 < threshold < 1:
        raise ValueError("need 0 < threshold < 1")
    asked, left, texts, right = trigram_tables(probes.select(F.col(probe).alias("value")), corpus.select(F.col(key).alias("value")))
    floors = cut_lineage(first_look(left, right, top, skip_equal))
    floors = cut_lineage(second_look(left, right, floors, threshold, top, skip_equal))
    pairs = similar_sets(left, right, floors, threshold)

    first = Window.partitionBy("value").orderBy(corpus_id)
    smallest = corpus.select(F.col(key).alias("value"), F.col(corpus_id)).where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= top).drop("_rn")
    # One value may have to be left out for being equal to the probe; at most ``top`` rows hold it.
    in_set = Window.partitionBy("right_node").orderBy(corpus_id)
    standing = (
        texts.join(smallest, "value").select(F.col("node").alias("right_node"), F.col("value").alias("match"), corpus_id)
        .withColumn("_rn", F.row_number().over(in_set)).where(F.col("_rn") <= 2 * top).drop("_rn")
    )
    nearest = Window.partitionBy("left_node").orderBy(F.desc("similarity"), F.asc(corpus_id))
    reachable = pairs.join(standing, "right_node").withColumn("_rn", F.row_number().over(nearest)).where(F.col("_rn") <= 2 * top).drop("_rn")
    members = asked.select(F.col("node").alias("left_node"), F.col("value").alias("_probe"))
    matched = reachable.join(members, "left_node")
    if skip_equal:
        matched = matched.where(F.col("_probe") != F.col("match"))
    best = Window.partitionBy("_probe").orderBy(F.desc("similarity"), F.asc(corpus_id))
    return (
        matched.withColumn("match_rank", F.row_number().over(best)).where(F.col("match_rank") <= top)
        .select(F.col("_probe").alias(probe), F.col(corpus_id).alias("match_id"), "match", "similarity", "match_rank")
    )
