"""Near-duplicate vectors: exact range join by cosine, with pivots in the metric of unit vectors.

On unit vectors cosine c is the distance sqrt(2 - 2c). Pivots part the vectors of a label into cells
by nearest pivot; a vector whose distance to another pivot is at most twice the range above that
to its own is also sent there, which by the triangle inequality brings every partner of a vector into
the vector's home cell. Cells join on their own. Large cells are parted again by pivots of their own
as long as that saves work; what stays large is joined in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import settle
from dossier.llm.graph import components

ALIKE, CELL, PIVOTS, LEVELS, BLOCK = 0.98, 1024, 64, 6, 2048
_SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def usable() -> Column:
    """Whether a row of ``label, v`` takes part in the join; never null."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``id, h1, h2``: id and class of equal vectors) and one row per class.

    Only rows with a label and a usable vector take part; vectors meet only within a label and a
    dimension. Equal vectors are one class, so copies cost nothing in the join. ``rep`` numbers the
    classes, ``low`` is the smallest id in one (null if it has none): neither null ids nor ids that
    repeat with other vectors mix classes up. Write the classes before using the number twice.
    """
    keyed = rows.where(usable()).withColumns({
        "h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "v", "label"),
    })
    classes = keyed.groupBy("h1", "h2").agg(
        F.min("id").alias("low"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v"),
    )

    def unit(batches):
        for batch in batches:
            out = []
            for v in batch.column(5).to_pylist():
                x = np.array(v, np.float64)
                x = x / np.abs(x).max()
                out.append(x / np.sqrt(np.dot(x, x)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([f"{a}|{len(x)}" for a, x in zip(batch.column(4).to_pylist(), out, strict=True)], pa.string()), pa.array(out, pa.list_(pa.float64()))],
                names=["h1", "h2", "low", "w", "cell", "v"],
            )

    units = classes.select("h1", "h2", "low", "w", F.col("label").cast("string"), "v").mapInArrow(unit, "h1 long, h2 long, low long, w long, cell string, v array<double>")
    return keyed.select("id", "h1", "h2"), units.withColumn("rep", F.monotonically_increasing_id())


def _assign(reach: float):
    """Home and boundary cells of one batch of a parent cell's rows, given the parent's pivots."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.iloc[:0][["cell", "home", "rep", "w", "v"]]
        right = right.sort_values("pivot")
        x, p = _matrix(left["v"]), _matrix(right["v"])
        d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ p.T), 0.0))
        near = d.argmin(axis=1)
        row, cell = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * reach + _SLACK)
        pivots = right["pivot"].to_numpy()
        out = left.iloc[row]
        return pd.DataFrame({
            "cell": [f"{c}/{q}" for c, q in zip(out["cell"], pivots[cell], strict=True)], "home": out["home"].to_numpy() & (near[row] == cell),
            "rep": out["rep"].to_numpy(), "w": out["w"].to_numpy(), "v": out["v"].to_numpy(),
        })

    return run


def cells(units: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``cell, home, rep, w, v``: every class once as ``home``, and as guest wherever partners may live."""
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * alike)))
    state = settle(units.select("cell", F.lit(True).alias("home"), "rep", "w", "v"), "cells")
    done = None
    sizes = lambda df: df.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
    for level in range(LEVELS):
        counts = settle(sizes(state), "counts")
        large = counts.where(f"n > {CELL}")
        if large.isEmpty():
            break
        wanted = F.least(F.ceil(F.col("homes") / (CELL // 2)), F.lit(PIVOTS))
        split = settle(large.withColumns({"share": wanted / F.greatest("homes", F.lit(1)), "salts": F.ceil(F.col("n") / BLOCK).cast("int")}), "split")
        open_rows = state.join(split, "cell")
        draw = F.pmod(F.xxhash64(F.lit(level), "rep"), F.lit(1 << 40)) / float(1 << 40)
        pivots = open_rows.where("home").where(draw < F.col("share")).select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("rep").alias("pivot"), "v")
        pivots = settle(pivots, "pivots")
        dealt = open_rows.select("cell", F.pmod(F.xxhash64("rep", F.lit(level)), F.col("salts")).cast("int").alias("salt"), "home", "rep", "w", "v")
        parted = settle(dealt.groupBy("cell", "salt").cogroup(pivots.groupBy("cell", "salt")).applyInPandas(
            _assign(reach), "cell string, home boolean, rep long, w long, v array<double>",
        ), "parted")
        parent = F.regexp_extract("cell", "^(.*)/[^/]*$", 1)
        work = sizes(parted).groupBy(parent.alias("cell")).agg(F.sum(F.col("n") * F.col("homes")).alias("work"))
        saved = settle(split.join(work, "cell").where("work < 0.6 * n * homes").select("cell"), "saved")
        finished = state.join(saved, "cell", "left_anti")
        done = finished if done is None else done.unionByName(finished)
        state = settle(parted.withColumn("parent", parent).join(saved.withColumnRenamed("cell", "parent"), "parent", "left_semi").select("cell", "home", "rep", "w", "v"), "cells")
    return state if done is None else done.unionByName(state)


def _block_links(alike: float):
    """Links of one pair of blocks: weight of partners per home vector, and a spanning star per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = pdf[pdf["own"]], pdf[~pdf["own"]]
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"rep": [], "links": [], "to": []}, dtype="int64")
        a, b = mine["rep"].to_numpy(), theirs["rep"].to_numpy()
        hit = (_matrix(mine["v"]) @ _matrix(theirs["v"]).T >= alike) & (a[:, None] != b[None, :])
        weight = hit @ theirs["w"].to_numpy().astype(np.float64)
        # The smallest label spreads over the block's links until it stands; each vector then points to it.
        label_a, label_b = a.copy(), b.copy()
        big = np.iinfo(np.int64).max
        while hit.any():
            new_a = np.minimum(label_a, np.where(hit, label_b[None, :], big).min(axis=1))
            new_b = np.minimum(label_b, np.where(hit, new_a[:, None], big).min(axis=0))
            if (new_a == label_a).all() and (new_b == label_b).all():
                break
            label_a, label_b = new_a, new_b
        rows_a, rows_b = hit.any(axis=1), hit.any(axis=0)
        return pd.DataFrame({
            "rep": np.concatenate((a[rows_a], b[rows_b])), "links": np.concatenate((weight[rows_a].astype(np.int64), np.zeros(int(rows_b.sum()), np.int64))),
            "to": np.concatenate((label_a[rows_a], label_b[rows_b])),
        })

    return run


def block_links(placed: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``rep, links, to`` from all cells; a cell of any size is joined in blocks of bounded size."""
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(blocks, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = rows.where("home").select("cell", F.col("mine").alias("i"), every.alias("j"), F.lit(True).alias("own"), "rep", "w", "v")
    other = rows.select("cell", every.alias("i"), F.col("mine").alias("j"), F.lit(False).alias("own"), "rep", "w", "v")
    return own.unionByName(other).groupBy("cell", "i", "j").applyInPandas(_block_links(alike), "rep long, links long, to long")


def link_classes(vectors: DataFrame, alike: float = ALIKE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows without a label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing and are their own component, also where their id has another
    row. Rows that repeat an id count as vectors of their own. Vectors of different dimension do not
    meet. A null id counts as a partner of others and has their smallest id as its component; where
    none of them has an id the component is null and the row is kept.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    members, units = distinct_vectors(rows)
    members, units = settle(members, "members"), settle(units, "units")
    found = settle(block_links(cells(units, alike), alike), "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    grouped = settle(units.select("h1", "h2", "rep", "low", "w").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", "low", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"),
    ), "grouped")
    lowest = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
    facts = settle(grouped.join(lowest, "group").select("h1", "h2", "n_links", "component_id"), "facts")
    linked = members.join(facts, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
