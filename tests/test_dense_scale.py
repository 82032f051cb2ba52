"""The dense kernel: rows as by brute force, and sorts that do not grow with the number of queries."""

import numpy as np
import pyarrow as pa
import pytest

from dossier.operators import dense


def arrays(vectors, ids):
    return {"known": [], "ids": pa.array(ids), "key": ids, "unit": dense._unit_rows(pa.array(vectors.tolist(), pa.list_(pa.float64()))), "codes": []}


@pytest.mark.parametrize(("n", "skip"), [(1, True), (10, True), (10, False), (700, True)])
def test_blocks_give_the_rows_of_all_pairs(n, skip, monkeypatch):
    """Ties, copies, a zero vector, a vector without direction, and more places than a batch has chunks."""
    gen = np.random.default_rng(n)
    vectors = np.round(gen.normal(size=(1500, 6)), 1)
    vectors[200:260], vectors[7], vectors[8, 0] = vectors[0], 0.0, np.nan
    ids = np.arange(1500) * 3
    monkeypatch.setattr(dense, "QUERY_BLOCK", 128)
    queries, best, longest = arrays(vectors, ids), dense._Best(n), []
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: longest.append(len(keys[0])) or sort(keys))
    for low in range(0, 1500, 600):
        dense._fold(best, queries, ids[low : low + 600], queries["unit"][low : low + 600], [], n, skip)
    monkeypatch.setattr(np, "lexsort", sort)
    got = {}
    out = dense._result(best, queries, ["q", "c", "s"], [pa.int64(), pa.int64(), pa.float64()])
    for q, c, s in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True):
        got.setdefault(q, []).append((-s, c))
    scores = np.round(queries["unit"] @ queries["unit"].T, 9) + 0.0
    for q in range(0, 1500, 7):
        all_ = sorted((-scores[q, c], int(ids[c])) for c in range(1500) if np.isfinite(scores[q, c]) and not (skip and c == q))[:n]
        assert [c for _, c in sorted(got.get(int(ids[q]), []))] == [c for _, c in all_]
    # Each sort holds the rows of one block of queries, not the lists of all 1,500.
    assert max(longest) <= 128 * (n + 600)
    if n == 10:
        assert np.median(longest) < 1500 * n


def test_few_products_are_scored_again(monkeypatch):
    gen = np.random.default_rng(3)
    vectors, ids, scored = gen.normal(size=(6000, 16)), np.arange(6000), []
    queries, best = arrays(vectors[:300], ids[:300]), dense._Best(5)
    add = best.add
    best.add = lambda low, row, score, chunk: scored.append(len(row)) or add(low, row, score, chunk)
    unit = arrays(vectors, ids)["unit"]
    for low in range(0, 6000, 1000):
        dense._fold(best, queries, ids[low : low + 1000], unit[low : low + 1000], [], 5, True)
    assert sum(scored) < 300 * 6000 / 100
