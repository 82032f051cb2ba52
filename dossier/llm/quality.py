"""Quality score: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import remainder, settle, slices

SHRINK, RIDGE = 0.2, 1e-3
STATISTICS = (
    "words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "spaces",
    "distinct_words", "top_word", "repeated_lines", "line_words", "sentence_words", "capitalised", "symbol_words",
)


def statistics(text: str | None) -> list[float]:
    """One number per entry of STATISTICS from the whole text, on scales that are near normal.

    Shares go through log(share + 0.001), sizes through log(1 + size). Null counts as empty.
    """
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.bincount(points[points < 128], minlength=128)
    upper, lower = int(low[65:91].sum()), int(low[97:123].sum())
    digits, spaces = int(low[48:58].sum()), int(low[9:14].sum() + low[32])
    punctuation = int(low[[33, 39, 44, 46, 58, 59, 63]].sum())
    symbols = int(low[33:127].sum()) - upper - lower - digits - int(low[[39, 44, 46, 58, 59, 63]].sum())
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    repeated = len(lines) - len(set(lines))
    ends = int(low[[33, 46, 63]].sum())
    share = lambda part, whole: math.log(part / max(1, whole) + 1e-3)
    size = lambda x: math.log1p(x)
    return [
        size(len(words)), size(lengths.mean()), size(lengths.std()), share(upper, upper + lower), share(digits, chars),
        share(punctuation, chars), share(symbols, chars), share(spaces, chars), math.log(len(counts) / n + 1e-3) if words else 0.0,
        share(max(counts.values(), default=0), n), share(repeated, len(lines)), size(n / max(1, len(lines))), size(n / max(1, ends)),
        share(sum(1 for w in words if w[0].isupper()), n), share(sum(1 for w in words if not w[-1].isalpha() and w[-1] not in ".,;:?"), n),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, stats``: the statistics of every row's whole text, one pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            stats = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, stats array<double>")


class Discriminant:
    """Two Gaussian classes; each keeps its mean and the inverse of its Cholesky factor."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE):
        n = {c: m[0] for c, m in moments.items()}
        total = sum(n.values())
        self.share = (n.get(1, 0.0) + 1.0) / (total + 2.0)
        self.fitted = min(n.get(0, 0), n.get(1, 0)) >= 2
        if not self.fitted:
            return
        mean = sum(m[1] for m in moments.values()) / total
        spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments.values()) / total - np.outer(mean, mean)), 1e-9))
        self.mean, self.spread, self.classes = mean, spread, {}
        covariances = {}
        for c, (k, s, ss) in moments.items():
            mu = s / k
            covariances[c] = (mu, (ss / k - np.outer(mu, mu)) / np.outer(spread, spread))
        pooled = sum(n[c] * covariances[c][1] for c in n) / total
        for c, (mu, own) in covariances.items():
            sigma = (1 - shrink) * own + shrink * pooled
            sigma = (1 - shrink) * sigma + shrink * np.eye(len(mu)) * np.trace(sigma) / len(mu) + ridge * np.eye(len(mu))
            factor = np.linalg.cholesky(sigma)
            self.classes[c] = ((mu - mean) / spread, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of Mahalanobis log densities and the prior."""
        if not self.fitted or not len(x):
            return np.full(len(x), self.share)
        z = (x - self.mean) / self.spread
        density = {c: -0.5 * np.square((z - mu) @ inverse.T).sum(axis=1) - logdet for c, (mu, inverse, logdet) in self.classes.items()}
        margin = density[1] - density[0] + math.log(self.share / (1 - self.share))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", **regular: float) -> Discriminant:
    """Class moments of all labelled rows, summed in Spark; what reaches the driver is 2 x (d*d + d + 1) numbers.

    A document with contradicting labels teaches nothing; null labels are ignored. With fewer than
    two rows of a class every score is the share of class 1 among the labels (0.5 without labels).
    """
    one = (
        labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("y_max")).where("y = y_max").select("labelled", F.col("y").cast("int").alias("y"))
    )
    d = len(STATISTICS)

    def run(batches):
        sums = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
        for batch in slices(batches):
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.ones((len(y), d + 1))
            x[:, 1:] = np.array(batch.column(1).to_pylist()).reshape(len(y), d)
            for c in sums:
                sums[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c in sums for _ in range((d + 1) ** 2)], pa.int32()), pa.array([*range((d + 1) ** 2)] * 2, pa.int32()), pa.array(np.concatenate([m.ravel() for m in sums.values()]))],
            names=["y", "at", "v"],
        )

    joined = stats.join(one, stats["doc_id"] == one["labelled"]).select("y", "stats")
    rows = joined.mapInArrow(run, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    grids = {0: np.zeros((d + 1) ** 2), 1: np.zeros((d + 1) ** 2)}
    for r in rows:
        grids[r["y"]][r["at"]] = r["v"]
    moments = {c: g.reshape(d + 1, d + 1) for c, g in grids.items()}
    return Discriminant({c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in moments.items() if m[0, 0] > 0}, **regular)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score`` for every row of ``stats``."""

    def run(batches):
        for batch in slices(batches):
            x = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema[0].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **regular: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Learns from labelled documents whose crc32(doc_id as text) mod 5 is not 0; the rest is held
    out. Statistics are measured once, written, and read for fitting and for scoring. Null and
    empty texts have defined statistics and a score; repeated rows each give a row.
    """
    stats = settle(measure(docs), "stats")
    model = fit(stats.where(remainder("doc_id", 5) != 0), labels, **regular)
    return score(stats, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
    )
