"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import remainder, slices

PROFILE, TOP, UNDETERMINED = 400, 300, "und"
_EDGE, _BITS, _FLUSH = 1, np.uint64(21), 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for everything that is no letter."""
    table = np.zeros(0x110000, np.uint64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def grams(text: str | None) -> np.ndarray:
    """Codes of all letter 1-, 2- and 3-grams; words are parted by an edge mark. Empty if no letter."""
    if not text:
        return np.zeros(0, np.uint64)
    letters = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    line = np.zeros(len(letters) + 2, np.uint64)
    line[1:-1] = letters
    keep = line != 0
    keep[1:] |= keep[:-1]
    if not keep.any():
        return np.zeros(0, np.uint64)
    line = line[keep]
    line[line == 0] = _EDGE
    line = np.concatenate((np.array([_EDGE], np.uint64), line))
    two = (line[:-1] << _BITS) | line[1:]
    three = (two[:-1] << _BITS) | line[2:]
    return np.concatenate((line[line != _EDGE], two, three))


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.lexsort((values, -counts))[:top]]


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language over all its texts, most frequent first.

    Rows without a language or a letter teach nothing. Each task sums its n-grams before the shuffle.
    What reaches the driver is ``size`` codes for each distinct language.
    """

    def count(batches):
        held: dict[str, list] = {}
        n = 0

        def flush():
            for lang, parts in held.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(sums)],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(grams(text), return_counts=True))
                n += len(parts[-1][0])
                if n > _FLUSH:
                    merged = {k: np.unique(np.concatenate([p[0] for p in v]), return_inverse=True) for k, v in held.items()}
                    held = {k: [(m[0], np.bincount(m[1], np.concatenate([p[1] for p in held[k]])))] for k, m in merged.items()}
                    n = sum(len(v[0][0]) for v in held.values())
                    if n > _FLUSH // 2:
                        yield from flush()
                        n = 0
        yield from flush()

    counts = (
        docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
        .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Judge:
    """Out-of-place distance of a text's ranked n-grams to every profile at once."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.penalty = max((len(p) for p in profiles.values()), default=0)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.places = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.places[np.searchsorted(self.codes, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Nearest language (ties: first by name) and 1 - distance / greatest distance."""
        own = ranked(grams(text), self.top)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, own)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == own
        places = self.places[np.where(known, at, len(self.codes))]
        apart = np.abs(places - np.arange(len(own))[:, None])
        total = np.where(places < 0, self.penalty, np.minimum(apart, self.penalty)).sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (len(own) * self.penalty)


def identify(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` (0 to 1) of each row's whole text.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_llm_text"))

    def run(batches):
        judge = Judge(profiles)
        for batch in slices(batches):
            found = [judge(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{head}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """The rows of ``docs`` whose text gets a language; all columns pass unchanged.

    Rejected: null text, text without a letter, text that shares no n-gram with any profile.
    """
    at = docs.columns.index("text")

    def run(batches):
        judge = Judge(profiles)
        for batch in slices(batches):
            found = [judge(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and score > 0 for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(remainder("doc_id", 4) != 2)
