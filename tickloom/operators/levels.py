"""Best levels of a book in one sorted cell, from the life intervals of its levels.

A row that touches a level opens an interval with the level's new size; it ends at the
level's next touch or at a clear. The best level of every row is the largest rank among
the intervals over it: each interval is covered by two blocks whose length is a power of
two, and blocks hand their maximum down to their halves. Taking an interval out where it
was best leaves pieces whose maximum is the next level, so depth costs one pass a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DIRECT = 32
NEAR_ROWS = 256


@dataclass
class Side:
    """Intervals [start, end) of one side, best price last."""

    start: np.ndarray
    end: np.ndarray
    price: np.ndarray
    size: np.ndarray
    rows: int

    def totals(self) -> np.ndarray:
        change = np.zeros(self.rows + 1)
        np.add.at(change, self.start, self.size)
        np.subtract.at(change, self.end, self.size)
        return np.cumsum(change)[:-1]

    def levels(self) -> Iterator[np.ndarray]:
        """Per pass the interval that is best, next best, ... in every row; -1 where there is none."""
        start, end, rank = self.start, self.end, np.arange(len(self.start))
        while len(start):
            best = _largest(start, end, rank, self.rows)
            yield best
            start, end, rank = _without(start, end, rank, best)
        while True:
            yield np.full(self.rows, -1)


def _largest(start: np.ndarray, end: np.ndarray, rank: np.ndarray, rows: int) -> np.ndarray:
    """The largest rank over every row, -1 where no interval is."""
    width = np.frexp((end - start).astype("float64"))[1] - 1  # floor of the binary logarithm
    now = np.full(rows, -1)
    for level in range(int(width.max()), -1, -1):
        here = width == level
        np.maximum.at(now, start[here], rank[here])
        np.maximum.at(now, end[here] - (1 << level), rank[here])
        if level:
            half = 1 << (level - 1)
            below = now.copy()
            np.maximum(below[half:], now[:-half], out=below[half:])
            now = below
    return now


def _without(start: np.ndarray, end: np.ndarray, rank: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is left of the intervals outside the rows in which they were best."""
    edge = np.flatnonzero(np.diff(best, prepend=-2))
    stop = np.append(edge[1:], len(best))
    held = best[edge]
    edge, stop, held = edge[held >= 0], stop[held >= 0], held[held >= 0]
    opens, closes = np.concatenate([start, stop]), np.concatenate([end, edge])
    of = np.concatenate([rank, held])
    # of one interval, sorted openings and closings belong together one by one
    a, b = np.lexsort((opens, of)), np.lexsort((closes, of))
    left = opens[a] < closes[b]
    return opens[a][left], closes[b][left], of[a][left]


def side_of(name: str, side: np.ndarray, price: np.ndarray, size: np.ndarray, epoch: np.ndarray) -> Side:
    """The intervals of side B or A; ``epoch`` counts the clears up to each row."""
    n = len(side)
    at = np.flatnonzero(side == name)
    at = at[np.lexsort((at, price[at], epoch[at]))]
    stop = np.searchsorted(epoch, epoch[at], side="right")
    same = np.zeros(len(at), dtype=bool)
    same[:-1] = (epoch[at[1:]] == epoch[at[:-1]]) & (price[at[1:]] == price[at[:-1]])
    stop[:-1] = np.where(same[:-1], at[1:], stop[:-1])
    live = (size[at] > 0) & (stop > at)
    at, stop = at[live], stop[live]
    order = np.argsort(price[at] if name == "B" else -price[at], kind="stable")
    return Side(at[order], stop[order], price[at[order]], size[at[order]], n)


def near(side: Side, centre: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """How many levels lie within ``distance`` of every row's centre, and their size.

    Rows go in blocks: what a block opens with is a running sum over prices, and what it
    changes is added up for each of its rows.
    """
    count, volume = np.zeros(side.rows, dtype=np.int64), np.zeros(side.rows)
    known = np.isfinite(side.price)
    prices, level = np.unique(side.price[known], return_inverse=True)
    ask = np.flatnonzero(np.isfinite(centre))
    if not (len(prices) and len(ask)):
        return count, volume
    at = centre[ask]
    low, high = np.searchsorted(prices, at - distance), np.searchsorted(prices, at + distance, side="right")
    within = lambda i, c: (i >= 0) & (i < len(prices)) & (np.abs(prices[np.clip(i, 0, len(prices) - 1)] - c) <= distance)
    # the sum of centre and distance may be rounded, so the edges are tried themselves
    for edge, inside, outside, step in ((low, 0, -1, -1), (high, -1, 0, 1)):
        while (more := within(edge + outside, at)).any():
            edge += step * more
        while (less := (low < high) & ~within(edge + inside, at)).any():
            edge -= step * less
    first, last = np.zeros(side.rows, dtype=np.int64), np.zeros(side.rows, dtype=np.int64)
    first[ask], last[ask] = low, np.maximum(low, high)
    # at one row a level's old size goes before its new one comes
    when = np.concatenate([side.end[known], side.start[known]])
    by = np.argsort(when, kind="stable")
    none = np.zeros(len(level))
    when, rank = when[by], np.concatenate([level, level])[by]
    after = np.concatenate([none, side.size[known]])[by]
    gain = np.concatenate([-side.size[known], side.size[known]])[by]
    sign = np.concatenate([none - 1, none + 1])[by]
    size, live = np.zeros(len(prices)), np.zeros(len(prices))
    upto = lambda v: np.concatenate([[0], np.cumsum(v)])
    edges = np.arange(0, side.rows + NEAR_ROWS, NEAR_ROWS)
    cuts = np.searchsorted(when, edges)
    for row, i, j in zip(edges[:-1], cuts[:-1], cuts[1:]):
        rows = np.arange(row, min(row + NEAR_ROWS, side.rows))
        a, b = first[rows], last[rows]
        counts, sizes = upto(live), upto(size)
        hit = (when[i:j] <= rows[:, None]) & (rank[i:j] >= a[:, None]) & (rank[i:j] < b[:, None])
        count[rows] = np.rint(counts[b] - counts[a] + hit @ sign[i:j])
        volume[rows] = np.where(count[rows] > 0, sizes[b] - sizes[a] + hit @ gain[i:j], 0.0)
        size[rank[i:j]], live[rank[i:j]] = after[i:j], sign[i:j] > 0  # of one level the last change stays
    return count, volume


def taken(side: Side, row: np.ndarray, within: np.ndarray, size: np.ndarray, above: bool) -> np.ndarray:
    """How many levels orders arriving after ``row`` use up, best first, at prices up to
    (from, if ``above``) ``within``. Row -1 stands for an empty book."""
    count, rest = np.zeros(len(row)), size.astype("float64").copy()
    live = np.flatnonzero((row >= 0) & (rest > 0))
    good = (lambda p, w: p >= w) if above else (lambda p, w: p <= w)
    levels = side.levels()
    while len(live) > DIRECT:
        best = next(levels)[row[live]]
        hit = best >= 0
        hit[hit] = good(side.price[best[hit]], within[live[hit]])
        live, best = live[hit], best[hit]
        count[live] += 1
        rest[live] -= side.size[best]
        live = live[rest[live] > 0]
    for i in live:  # few are left: their ladders directly
        over = np.flatnonzero((side.start <= row[i]) & (side.end > row[i]))[::-1]
        sizes = side.size[over[good(side.price[over], within[i])]]
        count[i] = min(int(np.searchsorted(np.cumsum(sizes), size[i])) + 1, len(sizes))
    return count
