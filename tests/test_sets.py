"""Feature sets against their steps, levels and modes against counting, one pin for a huge key."""

import numpy as np
import pytest

from support import SF, rows
from tickloom import order as tick_order
from tickloom.operators import bundles, classification, levels, microstructure
from tickloom.operators.classification import _mode_share
from tickloom.order import EventOrder
from tickloom.plans.binding import mbo
from tickloom.plans.bundles_q import _CORE


@pytest.mark.parametrize("name", ["advanced_features_v1", "execution_aware_medium_v1"])
def test_a_set_is_its_steps(spark, name):
    """One pass gives what every step gives on its own."""
    m, order = mbo(spark, SF).select(*_CORE), EventOrder(hot=False)
    whole = bundles.feature_set(m, order, name)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString().replace("BroadcastHashJoin", "")
    alone = m
    for step in bundles.FEATURE_SETS[name]:
        if step in bundles.CHAINED:
            alone = bundles.STEPS[step](alone, order)
    numbers = lambda d, have: [c for c, t in d.dtypes if t in ("double", "bigint", "int") and c not in have]
    cols = numbers(alone, _CORE)
    assert rows(whole, "sequence", *cols) == rows(alone, "sequence", *cols)
    seen = set(alone.columns)
    for step in bundles.FEATURE_SETS[name]:
        if step not in bundles.CHAINED:
            side = bundles.STEPS[step](m, order)
            cols = numbers(side, seen)
            assert cols and rows(whole, "sequence", *cols) == rows(side, "sequence", *cols)
            seen |= set(cols)


def test_best_levels_by_counting():
    r = np.random.default_rng(4)
    n = 700
    side = r.choice(["B", "A", ""], n, p=[0.45, 0.45, 0.1]).astype(object)
    price, size = r.integers(0, 30, n).astype(float), r.integers(0, 4, n).astype(float)
    epoch = np.cumsum(r.random(n) < 0.01)
    limit, take = r.integers(0, 30, n).astype(float), r.integers(1, 9, n).astype(float)
    for name, sign in (("B", 1), ("A", -1)):
        s = levels.side_of(name, side, price, size, epoch)
        tops = [best for best, _ in zip(s.levels(), range(6))]
        counted = levels.taken(s, np.arange(n) - 1, limit, take, above=name == "B")
        few = np.concatenate([levels.taken(s, np.array([i]), limit[[i + 1]], take[[i + 1]], above=name == "B") for i in range(n - 1)])
        book, now = {}, 0
        for i in range(n):
            ladder = sorted(book.items(), key=lambda x: -sign * x[0]) if i else []
            rest, used = take[i], 0
            for p, q in ladder:
                if rest <= 0 or sign * (p - limit[i]) < 0:
                    break
                used, rest = used + 1, rest - q
            assert counted[i] == used and (not i or few[i - 1] == used)
            if epoch[i] != now:
                book, now = {}, epoch[i]
            if side[i] == name:
                book.pop(price[i], None)
                if size[i] > 0:
                    book[price[i]] = size[i]
            ladder = sorted(book.items(), key=lambda x: -sign * x[0])
            assert [(s.price[t[i]], s.size[t[i]]) for t in tops if t[i] >= 0] == ladder[:6]
            assert s.totals()[i] == sum(book.values())


@pytest.mark.parametrize("values", [3, 40, 900])
def test_mode_share_by_counting(values):
    x = np.random.default_rng(values).integers(0, values, 950)
    for n in (1, 7, 100, 950, 951):
        want = [np.unique(x[i - n + 1 : i + 1], return_counts=True)[1].max() / n if i >= n - 1 else np.nan for i in range(len(x))]
        assert np.array_equal(_mode_share(x, n), want, equal_nan=True)


@pytest.mark.parametrize("operator", [microstructure.trade_runs, microstructure.spoofing, classification.by_side])
def test_a_huge_key_is_sorted_once(frame, monkeypatch, operator):
    """The steps of an operator share the numbering of the key; results are those of the plain form."""
    pins = []
    monkeypatch.setattr(tick_order, "pin", lambda df, pin=tick_order.pin: pins.append(df) or pin(df))
    more = (20,) if operator is classification.by_side else ()
    for conf, value in (("tickloom.hotKeyRows", "2000"), ("tickloom.cellRows", "90")):
        frame.sparkSession.conf.set(conf, value)
    try:
        hot = operator(frame, EventOrder(hot=True, cell_rows=90), *more)
        plain = operator(frame, EventOrder(hot=False), *more)
        cols = [c for c in plain.columns if c.startswith(("micro_", "flow_"))]
        assert cols and len(pins) == 1
        assert rows(hot, "instrument", "sequence", *cols) == rows(plain, "instrument", "sequence", *cols)
    finally:
        for conf in ("tickloom.hotKeyRows", "tickloom.cellRows"):
            frame.sparkSession.conf.unset(conf)
