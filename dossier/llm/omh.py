"""Order MinHash: a sketch of a sequence that reacts to its edit distance.

Every k-mer is labelled with the number of its earlier occurrences. Each component of the sketch
takes, under its own pseudorandom order, the ``tuple_size`` smallest labelled k-mers, puts them
back into text order, and hashes that tuple. Two texts agree in a component if they share those
k-mers and hold them in the same order.
"""

from __future__ import annotations

import functools

import numpy as np

from dossier.llm.common import mix

_BLOCK = 1 << 18


@functools.cache
def _orders(size: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64))
    return (seeds[:size] >> np.uint64(32)).astype(np.uint32), (seeds[size:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def label_occurrences(kmers: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with their occurrence number, in text order."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    fresh = np.ones(len(kmers), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return mix(kmers)
    first = np.flatnonzero(fresh)
    nth = np.arange(len(kmers)) - np.repeat(first, np.diff(first, append=len(kmers)))
    labels = np.empty(len(kmers), np.uint64)
    labels[order] = nth
    return mix(kmers ^ mix(labels) ^ mix(np.zeros(1, np.uint64)))


def sketch(kmers: np.ndarray, size: int, tuple_size: int = 2) -> np.ndarray:
    """``size`` 64-bit components; no k-mers give zeros."""
    if not len(kmers):
        return np.zeros(size, np.uint64)
    labelled = label_occurrences(kmers)
    small = (labelled >> np.uint64(32)).astype(np.uint32)
    xor, odd = _orders(size)
    take = min(tuple_size, len(kmers))
    at = np.empty((size, take), np.int64)
    step = max(1, _BLOCK // len(kmers))
    for lo in range(0, size, step):
        hi = min(size, lo + step)
        ranks = (small[None, :] ^ xor[lo:hi, None]) * odd[lo:hi, None]
        rows = np.arange(hi - lo)
        for j in range(take):
            at[lo:hi, j] = best = ranks.argmin(axis=1)
            ranks[rows, best] = np.uint32(0xFFFFFFFF)
    at.sort(axis=1)
    out = np.full(size, take, np.uint64)
    for j in range(take):
        out = mix(out ^ labelled[at[:, j]])
    return out
