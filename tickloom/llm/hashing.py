"""Hashes of words and shingles over blocks of text bytes, without a Python object per word."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

# the separators of words: space and bytes 9 to 13
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64 for i < n."""
    if len(_POWERS[0]) < n:
        for at, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[at] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a text's edge also ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = ~SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial from running sums, mixed with the length."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, number of words before each text and in all)."""
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of each text.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    hashes, first = words(data, offsets)
    joined = np.zeros(max(len(hashes) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        joined = (joined ^ hashes[i : i + len(joined)]) * np.uint64(0x9FB21C651E98DF25)
        joined ^= joined >> np.uint64(32)
    joined = mix(joined, k)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in hashes[a:b]:
                h = mix(np.array([h ^ w]), 99)[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
