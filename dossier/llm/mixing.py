"""Mixing sources to target weights. DataFrame functions only.

Words are packed into blocks of fixed length along each source; the last one may be shorter. Every
source gets the output slots that hold its target, the last of them cut to the words still wanted.
One pseudorandom permutation deals all slots to the output shards, which draws each shard's source
counts: a multinomial draw given the totals, so each target is met to the word. A second permutation
per source maps its slots to block indices, one pass over all blocks after the other, and slots
meet blocks by a join on that index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import settle, shuffle_width

WORD, TAIL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
BLOCK, SHARD, SEED, CHUNK, BUCKET = 64, 1 << 14, 17, 4096, 1024
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``rank`` and ``weight`` to a table of distinct sources, in code-point order, null last.

    The table has a row per source and stands in one window.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("rank", place).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights)))


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to ``sources(source, source_size, weight)``.

    ``share`` of all sizes is dealt by weight; a target stops at ``cap`` times its source's size and
    what is over goes to the others by weight. In the order of cap/weight the stopped sources come
    first, so one running sum finds the level at which the rest stand.
    """
    stop, order = cap * F.col("source_size"), Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sums = sources.withColumn("_ratio", stop / F.col("weight")).withColumns({
        "_total": share * F.sum("source_size").over(everything),
        "_before": F.coalesce(F.sum(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_weights": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    level = (F.col("_total") - F.col("_before")) / F.col("_weights")
    at = F.coalesce(F.max(F.when(level <= F.col("_ratio"), level)).over(everything), F.max("_ratio").over(everything))
    return sums.withColumn("target", F.least(stop, at * F.col("weight"))).drop("_ratio", "_total", "_before", "_weights")


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """Pseudorandom permutation of 0..n-1: four Feistel half rounds over a near-square grid.

    A value that falls on one of the grid's few spare places is sent on until it is below ``n``.
    Up to 4,096 values the 64 steps allowed are more than there are spare places; beyond that a step
    misses with probability below 1/64.
    """
    wide = F.greatest(F.ceil(F.sqrt(n)).cast("long"), F.lit(1))
    deep = F.greatest(F.ceil(n / wide).cast("long"), F.lit(1))

    def step(v: Column) -> Column:
        left, right = F.floor(v / deep).cast("long"), F.pmod(v, deep)
        for i in range(2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(2 * i), *seed), wide), wide)
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(2 * i + 1), *seed), deep), deep)
        return left * deep + right

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col("_first"), lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return step(x), walk


def with_permuted(df: DataFrame, name: str, x: Column, n: Column, *seed: Column) -> DataFrame:
    first, walk = permuted(x, n, *seed)
    return df.withColumn("_first", first).withColumn(name, F.when(F.col("_first") < n, F.col("_first")).otherwise(walk)).drop("_first")


def slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``rank, block, copy, length, shard, position`` of every output slot of ``plan``.

    ``length`` is what the slot holds of its block, from the block's start: all of it but for the
    last slot of a source. A source's short last block ends each pass; the others come in the order
    of the source's permutation.
    """
    order = Window.orderBy("rank")
    placed = plan.select("rank", "source_size", "wanted", "blocks", "slots").where("slots > 0").withColumns({
        "low": F.sum("slots").over(order) - F.col("slots"), "all": F.sum("slots").over(Window.partitionBy()),
    })
    last = F.floor((F.col("slots") - 1) / CHUNK)
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(shuffle_width(plan), "rank", "chunk")
    each = chunks.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1))).withColumns({
        "copy": F.floor(F.col("i") / F.col("blocks")), "j": F.col("i") % F.col("blocks"), "full": F.floor(F.col("source_size") / block),
    })
    each = with_permuted(each, "position", F.col("low") + F.col("i"), F.col("all"), F.lit(seed))
    each = with_permuted(each, "dealt", F.col("j"), F.greatest("full", F.lit(1).cast("long")), F.lit(seed + 1), F.col("rank"))
    before = F.col("j") * block
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - before, F.col("wanted") - F.col("copy") * F.col("source_size") - before)
    return each.select(
        "rank", F.when(F.col("j") < F.col("full"), F.col("dealt")).otherwise(F.col("j")).alias("block"), "copy", length.alias("length"),
        F.floor(F.col("position") / shard).alias("shard"), "position",
    )


def shard_counts(plan: DataFrame, **options: int) -> DataFrame:
    """``shard, source, slots, words``: the source counts drawn for each output shard."""
    drawn = slots(plan, **options).groupBy("shard", "rank").agg(F.count("*").alias("slots"), F.sum("length").alias("words"))
    return drawn.join(plan.select("rank", "source"), "rank").select("shard", "source", "slots", "words")


def layout(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys, source, size, start``: each row's words and where they begin in its source.

    The order inside a source is by hashed bucket, then by key; the last of several keys only parts
    ties, so the order does not depend on how rows lie in files. Running sums are taken inside a
    bucket (about 1,024 rows, however large the source) and over the buckets' sums.
    """
    buckets = max(1, -(-docs.count() // BUCKET))
    rows = docs.withColumn("bucket", F.pmod(F.xxhash64(*(keys[:-1] or keys)), F.lit(buckets)))
    inside = Window.partitionBy("source", "bucket").orderBy(*keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"),
    )
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        *keys, "source", "size", (F.col("base") + F.col("inner")).alias("start"),
    )


def make_plan(sizes: DataFrame, block: int = BLOCK, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row per source: ``source, rank, source_size, target, wanted, blocks, slots``; written once.

    ``wanted`` is the target in whole words, ``slots`` the number of blocks that hold them.
    """
    sources = settle(cycling_weights(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    size, wanted = F.col("source_size"), F.least(F.floor(F.col("target") + 0.5), F.floor(cap * F.col("source_size"))).cast("long")
    planned = targets(sources, share, cap).withColumn("blocks", F.ceil(size / block).cast("long")).withColumn("wanted", wanted)
    some = F.floor(F.col("wanted") / size) * F.col("blocks") + F.ceil((F.col("wanted") % size) / block)
    return settle(planned.withColumn("slots", F.when(size > 0, some).otherwise(0).cast("long")), "plan")


def pieces(sizes: DataFrame, plan: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """``keys, size, rank, start, at, words, times, last, shard``: the part of each row in each block, and how often it is taken.

    The last of the ``times`` takes only the first ``last`` words of the part, each other all of
    them; ``shard`` is the first output shard that takes the block. Rows without words give none.
    """
    mine = plan.select(F.col("source").alias("s"), "rank")
    rows = layout(sizes, *keys).where("size > 0").join(mine, F.col("source").eqNullSafe(F.col("s")))
    end = F.col("start") + F.col("size")
    parts = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))).withColumns({
        "at": F.greatest(F.col("block") * block - F.col("start"), F.lit(0)),
        "words": F.least((F.col("block") + 1) * block, end) - F.greatest(F.col("block") * block, F.col("start")),
        "inside": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)),
    })
    times = slots(plan, block).groupBy("rank", "block").agg(F.count("*").alias("times"), F.min("length").alias("length"), F.min("shard").alias("shard"))
    # Both sides have a row for every block; their size cannot be seen in the table of sources they come from.
    found = parts.join(times.hint("merge"), ["rank", "block"], "left")
    last = F.coalesce(F.greatest(F.least("words", F.col("length") - F.col("inside")), F.lit(0)), F.lit(0))
    return found.select(*keys, "size", "rank", "start", "at", "words", F.coalesce("times", F.lit(0)).alias("times"), last.alias("last"), F.when(last + F.col("times") > 1, F.col("shard")).alias("shard"))


def mix_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, first_shard`` for every row.

    ``first_shard`` is the first output shard that holds a block of the row, null if none was
    taken. Null and blank texts have size 0 and are never taken. A null source is a source of its
    own. Repeated rows are separate documents. Equal runs on equal rows agree.
    """
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    plan = make_plan(sizes)
    words = F.when(F.col("times") > 0, F.col("words") * (F.col("times") - 1) + F.col("last")).otherwise(0)
    taken = pieces(sizes, plan, "doc_id").groupBy("doc_id", "size", "rank", "start").agg(F.sum(words).alias("taken"), F.min("shard").alias("first_shard"))
    facts = plan.select("source", "rank", "source_size", "target")
    with_words = taken.join(facts, "rank").select("doc_id", "size", "source", "source_size", "target", "taken", "first_shard")
    blank = sizes.where("size = 0").join(facts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return with_words.unionByName(blank.select(
        "doc_id", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"),
    ))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document cut to the blocks taken from it.

    A document gives one row for each pass that took words of it, so it may come twice or not at
    all; ``text`` holds the taken words in order with the white space after them, ``n_chars`` its
    length. Repeated rows are separate documents: rows are numbered and written before the mix.
    """
    numbered = settle(docs.withColumn("_llm_row", F.monotonically_increasing_id()), "numbered")
    keys = ["_llm_id", "_llm_hash", "_llm_row"]
    sizes = settle(numbered.select(
        F.col("doc_id").alias("_llm_id"), F.xxhash64("text", "source").alias("_llm_hash"), "_llm_row", "source", word_count(F.col("text")).alias("size"),
    ), "sizes")
    plan = make_plan(sizes)
    cuts = (
        pieces(sizes, plan, *keys).where("times > 0").groupBy("_llm_row")
        .agg(F.array_sort(F.collect_list(F.struct("at", "words", "times", "last"))).alias("_llm_cuts"))
    )
    tokens = F.regexp_extract_all("text", F.lit(WORD + TAIL), F.lit(0))
    most = F.array_max(F.transform("_llm_cuts", lambda c: c["times"]))

    def taken(k: Column) -> Column:
        here = F.filter("_llm_cuts", lambda c: (c["times"] > k + 1) | ((c["times"] == k + 1) & (c["last"] > 0)))
        return F.transform(here, lambda c: F.struct(c["at"].alias("at"), F.when(c["times"] > k + 1, c["words"]).otherwise(c["last"]).alias("words")))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), most - 1), taken), lambda c: F.size(c) > 0)
    whole = numbered.join(cuts, "_llm_row").withColumn("_llm_words", tokens).withColumn("_llm_copy", F.explode(copies))
    text = F.array_join(F.transform("_llm_copy", lambda c: F.array_join(F.slice("_llm_words", (c["at"] + 1).cast("int"), c["words"].cast("int")), "")), "")
    out = whole.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
