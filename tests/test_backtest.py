"""Positions, barrier exits, bootstrap and quantiles against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import rows
from tickloom.operators import backtest as bt
from tickloom.operators.quantiles import exact_quantiles, quantile_bins
from tickloom.order import EventOrder

ORDERS = [EventOrder(hot=False), EventOrder(hot=True, cell_rows=40)]


@pytest.mark.parametrize("order", ORDERS)
def test_positions(frame, events, order):
    fills = frame.filter("side <> 'N'")
    got = rows(bt.positions(fills, order), "instrument", "sequence", "position", "avg_price", "realized_pnl")
    want = []
    for key, g in events[events.side != "N"].groupby("instrument"):
        pos, avg, pnl = 0.0, 0.0, 0.0
        for r in g.sort_values("sequence").itertuples():
            q = r.size if r.side == "B" else -r.size
            if pos * q >= 0:
                avg = (abs(pos) * avg + abs(q) * r.price) / (abs(pos) + abs(q))
            else:
                pnl += min(abs(q), abs(pos)) * np.sign(pos) * (r.price - avg)
                if pos * (pos + q) < 0:
                    avg = r.price
                elif pos + q == 0:
                    avg = 0.0
            pos += q
            want.append((key, r.sequence, float(pos), round(avg, 6), round(pnl, 6)))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=str)]
    a = np.array([g[3:] for g in got])
    b = np.array([w[3:] for w in sorted(want, key=str)])
    assert np.abs(a - b).max() < 1e-5


@pytest.mark.parametrize("order", ORDERS)
def test_barrier_exits(frame, events, order):
    hold = 15_000_000
    d = frame.withColumn("go", (F.col("action") == "F") & (F.col("side") != "N"))
    got = rows(bt.barrier_exits(d, order, "go", "side", 0.5, 1.0, hold), "sequence", "exit_reason", "exit_ts", "exit_price")
    want = []
    for _, g in events.groupby("instrument"):
        g = g.sort_values("sequence").reset_index(drop=True)
        for i, r in g.iterrows():
            if r.action != "F" or r.side == "N":
                continue
            sign, last, why = (1 if r.side == "B" else -1), i, "time_limit"
            for j in range(i + 1, len(g)):
                if g.ts_event[j] > r.ts_event + hold:
                    break
                last = j
                move = sign * (g.price[j] - r.price)
                if move <= -0.5 or move >= 1.0:
                    why = "stop_loss" if move <= -0.5 else "take_profit"
                    break
            want.append((r.sequence, why, int(g.ts_event[last]), g.price[last]))
    assert got == sorted(want, key=str)


def test_bootstrap_is_stable_and_centred(spark):
    r = np.random.default_rng(1)
    pnl = r.normal(0.05, 1.0, 4000)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(pnl)], "k long, pnl double")
    a = bt.bootstrap_sharpe(d.repartition(3), "pnl", "k").first()
    b = bt.bootstrap_sharpe(d.repartition(9), "pnl", "k").first()
    assert np.allclose(list(a), list(b), rtol=1e-9)
    sharpe = pnl.mean() / pnl.std() * np.sqrt(252)
    assert a["sharpe_p05"] < sharpe < a["sharpe_p95"] and abs(a["sharpe_p50"] - sharpe) < 0.1


def test_exact_quantiles(spark):
    r = np.random.default_rng(3)
    x = np.round(r.exponential(10, 2000), 1)
    d = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(x)], "x double, g int")
    got = exact_quantiles(d, "x", {"a": 0.05, "b": 0.5, "c": 0.99}).first()
    assert np.allclose(list(got), np.quantile(x, [0.05, 0.5, 0.99]))
    assert quantile_bins(d, "x", "bin", 5).groupBy("bin").count().count() == 5
