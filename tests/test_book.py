"""Books against an event-by-event replay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import rows
from tickloom.operators import book, levels
from tickloom.order import EventOrder

ORDERS = [EventOrder(hot=False), EventOrder(hot=True, cell_rows=60)]


def level_replay(events):
    out = []
    for key, g in events.groupby("instrument"):
        sizes = {"B": {}, "A": {}}
        for r in g.sort_values("sequence").itertuples():
            if r.action == "R":
                sizes = {"B": {}, "A": {}}
            elif r.side in sizes and r.action in "ACF":
                old = sizes[r.side].get(r.price, 0)
                new = old + r.size if r.action == "A" else max(0, old - r.size)
                sizes[r.side][r.price] = new
            live = {s: [p for p, q in v.items() if q > 0] for s, v in sizes.items()}
            bid, ask = max(live["B"], default=None), min(live["A"], default=None)
            out.append((key, r.sequence, bid, ask, sum(sizes["B"].values()), sum(sizes["A"].values())))
    return sorted(((k, s, b, a, float(x), float(y)) for k, s, b, a, x, y in out), key=str)


@pytest.mark.parametrize("order", ORDERS)
def test_level_book_quotes(frame, events, order):
    got = book.book_at_events(book.level_book(frame, order), order, 3)
    assert rows(got, "instrument", "sequence", "best_bid", "best_ask", "bid_total", "ask_total") == level_replay(events)


def order_replay(events):
    out = []
    for key, g in events.groupby("instrument"):
        live = {}
        for r in g.sort_values("sequence").itertuples():
            if r.action == "R":
                live = {}
            elif r.action == "A" and r.side in "BA":
                live[r.order_id] = [r.side, r.price, r.size]
            elif r.action == "M" and r.order_id in live:
                live[r.order_id][1:] = [r.price, r.size]
            elif r.action == "C" and r.order_id in live:
                live[r.order_id][2] -= r.size
                if live[r.order_id][2] <= 0:
                    del live[r.order_id]
            bids = [p for s, p, _ in live.values() if s == "B"]
            asks = [p for s, p, _ in live.values() if s == "A"]
            total = sum(q for _, _, q in live.values())
            out.append((key, r.sequence, max(bids, default=None), min(asks, default=None), float(total)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", ORDERS)
def test_order_book_quotes(frame, events, order):
    d = book.book_at_events(book.order_book(frame, order), order, 0)
    d = d.withColumn("total", d.bid_total + d.ask_total)
    assert rows(d, "instrument", "sequence", "best_bid", "best_ask", "total") == order_replay(events)


def test_level_sizes_never_negative(frame):
    d = book.level_book(frame, ORDERS[0], "opposite")
    assert d.filter("level_size < 0 OR level_size_before < 0").count() == 0


def near_replay(events, distance):
    out = []
    for key, g in events.groupby("instrument"):
        sizes = {"B": {}, "A": {}}
        for r in g.sort_values("sequence").itertuples():
            if r.action == "R":
                sizes = {"B": {}, "A": {}}
            elif r.side in sizes and r.action in "ACF":
                old = sizes[r.side].get(r.price, 0)
                sizes[r.side][r.price] = old + r.size if r.action == "A" else max(0, old - r.size)
            close = [[q for p, q in sizes[s].items() if q > 0 and abs(p - r.price) <= distance] for s in "BA"]
            far = [float(sum(sizes[s].values()) - sum(c)) for s, c in zip("BA", close)]
            out.append((key, r.sequence, *[len(c) for c in close], *[float(sum(c)) for c in close], *far))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", ORDERS)
def test_localised_reads_the_whole_book(frame, events, order):
    """Near levels are counted wherever they stand, not only among the first of the book."""
    got = book.localised(book.level_book(frame, order), order, F.col("price"), 1.0, depth=2)
    cols = [f"{s}_{c}" for c in ("near_levels", "near_volume", "far_volume") for s in ("bid", "ask")]
    assert rows(got, "instrument", "sequence", *cols) == near_replay(events, 1.0)


@pytest.mark.parametrize("step", [0.1, 7.0])
def test_near_levels_by_counting(step):
    r = np.random.default_rng(3)
    n = 700
    side, size = r.choice(["B", ""], n, p=[0.9, 0.1]).astype(object), r.integers(0, 4, n).astype(float)
    price, centre = step * r.integers(0, 60, n), step * r.integers(-5, 65, n).astype(float)
    price[::90], centre[::50] = np.nan, np.nan
    epoch = np.cumsum(r.random(n) < 0.01)
    touched = np.where(np.isnan(price), "", side).astype(object)
    count, volume = levels.near(levels.side_of("B", touched, np.nan_to_num(price), size, epoch), centre, 3 * step)
    book_, now = {}, 0
    for i in range(n):
        if epoch[i] != now:
            book_, now = {}, epoch[i]
        if touched[i] == "B":
            book_[price[i]] = size[i]
        close = [q for p, q in book_.items() if q > 0 and abs(p - centre[i]) <= 3 * step]
        assert (count[i], volume[i]) == (len(close), sum(close))
