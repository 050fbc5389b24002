"""Operators with wide or many rows cut keys into small cells before they are huge."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from support import SF, rows
from tickloom import order as tick_order
from tickloom.operators import bundles, classification, tick_features
from tickloom.operators import horizons as hz
from tickloom.operators import order_flow as of
from tickloom.functions.ema import ema, ema_in_cells
from tickloom.order import EventOrder, windowed

ROWS = 4000


@pytest.fixture(scope="module")
def long_key(spark):
    r = np.random.default_rng(11)
    pdf = pd.DataFrame(
        {
            "instrument": "HOT", "ts_event": np.arange(ROWS) * 500_000_000, "sequence": np.arange(ROWS),
            "action": r.choice(["A", "C", "F"], ROWS), "side": r.choice(["B", "A"], ROWS), "order_id": r.integers(0, 60, ROWS).astype(str),
            "price": 100 + 0.25 * r.integers(0, 12, ROWS), "size": r.integers(1, 40, ROWS),
        }
    )
    spark.conf.set("tickloom.wideRows", "300")
    yield spark.createDataFrame(pdf).repartition(3).cache()
    spark.conf.unset("tickloom.wideRows")


def test_order_flow_windows_hold_a_cell(long_key, monkeypatch):
    probe = lambda d, f: d.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(*f.keys)))
    monkeypatch.setitem(of.BODIES, "probe", probe)
    cut = of.order_flow(long_key, EventOrder().measured(long_key), ["statistics", "probe"])
    whole = of.order_flow(long_key, EventOrder(hot=False), ["statistics", "probe"])
    assert cut.agg(F.max("held")).first()[0] <= 2 * of.REACH < ROWS
    cols = ["sequence", "price_zscore_120r", "vol_std_60r", "price_autocorr_lag_5", "price_entropy"]
    assert rows(cut, *cols) == rows(whole, *cols)


@pytest.fixture
def pins(monkeypatch):
    seen = []
    monkeypatch.setattr(tick_order, "pin", lambda df, pin=tick_order.pin: seen.append(df) or pin(df))
    return seen


@pytest.mark.parametrize("kind", ["sums", "price"])
def test_horizons_of_a_long_key_run_in_cells(long_key, pins, kind):
    spans = {"a": 7_000_000_000, "b": 400_000_000_000}
    at = {"sums": lambda o: hz.trailing(long_key, o, {"n": "size"}, spans, "scan"), "price": lambda o: hz.trailing_price(long_key, o, spans)}[kind]
    cut, made = at(EventOrder().measured(long_key)), len(pins)
    cols = ["sequence", *[f"{h}_{'n' if kind == 'sums' else 'price_change'}" for h in spans]]
    assert made and rows(cut, *cols) == rows(at(EventOrder(hot=False)), *cols)


def test_steps_of_a_feature_set_hold_a_cell(long_key, monkeypatch):
    """A long key's steps run in cells on the event columns; tied rows and null keys stay."""
    held = lambda d, f: d.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(*f.keys)))
    monkeypatch.setitem(bundles.STEPS, "probe", lambda d, o: windowed(d, o, held, before=5))
    monkeypatch.setitem(bundles.FEATURE_SETS, "tried", ["book", "normalised", "ofi", "probe", "cancel_share"])
    keys = F.when(F.col("sequence") % 3 > 0, F.col("instrument"))
    m = long_key.withColumns({"instrument": keys, "trade_date": F.to_date(F.timestamp_seconds(F.expr("ts_event div 1000000000")))})
    cut = bundles.feature_set(m, EventOrder().measured(m), "tried").cache()
    whole = bundles.feature_set(m, EventOrder(hot=False), "tried")
    assert cut.agg(F.max("held")).first()[0] <= 305 < whole.agg(F.max("held")).first()[0]
    assert cut.columns == whole.columns
    cols = [c for c, t in whole.dtypes if not t.startswith("array") and c != "held"]
    assert rows(cut, *cols) == rows(whole, *cols)


def test_pipeline_of_a_long_key_runs_in_parts(long_key, monkeypatch):
    """No window holds the arrays of the book; keys may be null, rows come twice."""
    m = long_key.filter("sequence < 1600").withColumn("instrument", F.when(F.col("sequence") % 3 > 0, F.col("instrument")))
    asked = []
    seen = lambda d, *more, was=bundles.microstructure.event_windows: asked.append(d.columns) or was(d, *more, (10, 70), 90)
    monkeypatch.setattr(bundles.microstructure, "event_windows", seen)
    cut = bundles.mbo_pipeline(m, EventOrder(hot=True, cell_rows=500))
    assert "bid_prices" not in asked.pop()
    whole = bundles.mbo_pipeline(m, EventOrder(hot=False, largest=9))
    cols = [c for c, t in whole.dtypes if not c.startswith("_") and not t.startswith("array")]
    assert sorted(cut.columns) == sorted(c for c in whole.columns if not c.startswith("_"))
    assert rows(cut, *cols) == rows(whole, *cols)


def test_columns_of_the_caller_stay(long_key):
    """Also those marked with a leading underscore, such as the row of a feature set in parts."""
    marked = long_key.withColumn(bundles.ROW, F.col("sequence"))
    for operator in (classification.flow_features, tick_features.event_features):
        made = operator(marked, EventOrder(hot=False)).columns
        assert bundles.ROW in made and not [c for c in made if c.startswith("_") and c != bundles.ROW]


def test_average_in_cells_is_the_average(long_key):
    alphas = {"fast": 0.1, "slow": 0.001}
    cut = ema_in_cells(long_key, EventOrder(hot=True, cell_rows=70), "price", alphas)
    whole = ema(long_key, EventOrder().frames(), {n: ("price", a, None) for n, a in alphas.items()})
    cut, whole = (d.orderBy("sequence").select(*alphas).toPandas().to_numpy() for d in (cut, whole))
    assert len(cut) == ROWS and np.allclose(cut, whole, rtol=1e-12)


def test_horizons_in_cells_are_frames(long_key):
    """Also of values that are not finite, and of rows that tie on the clock."""
    odd = F.when(F.col("sequence") % 997 == 5, float("nan")).when(F.col("sequence") % 499 == 7, float("inf")).otherwise(F.col("price"))
    d = long_key.withColumns({"ts_event": F.expr("ts_event - ts_event % 2000000000"), "odd": odd})
    spans, sums = {"a": 7_000_000_000, "b": 60_000_000_000}, {"n": "size", "p": "odd"}
    cut = hz.trailing(d, EventOrder(hot=True, cell_rows=300), sums, spans)
    whole = hz.trailing(d, EventOrder(hot=False), sums, spans, "frame")
    cols = ["sequence", *[f"{h}_{c}" for h in spans for c in ("n", "events")], *[f"{h}_p" for h in spans]]
    text = lambda x: rows(x.withColumns({f"{h}_p": F.round(f"{h}_p", 4).cast("string") for h in spans}), *cols)
    assert cut.columns and text(cut) == text(whole)


def test_flow_of_a_long_key_is_shuffled_once(long_key):
    """In cells of time, without a numbered copy of the rows; null, NaN, infinite and tied rows too."""
    at = lambda n, k: F.col("sequence") % n == k
    odd = F.when(at(991, 5), float("nan")).when(at(499, 7), float("inf")).when(~at(37, 3), F.col("price"))
    d = long_key.withColumns({
        "ts_event": F.when(~at(1300, 9), F.expr("ts_event - ts_event % 2000000000 - 700000000000")), "price": odd,
        "size": F.when(~at(41, 2), F.col("size")), "side": F.when(~at(43, 1), F.col("side")),
        "instrument": F.when(at(5, 1), "OTHER").when(~at(5, 2), F.col("instrument")),
    })
    assert tick_features._flow_in_cells(d, EventOrder(hot=False, largest=9), {"w1": 60_000_000_000}) is None
    cells, spans = EventOrder(hot=True, cell_rows=120), {"w1": 60_000_000_000, "w4": 240_000_000_000}
    cut = tick_features.flow_features(d, cells, [1, 4])
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    whole = tick_features._flow_columns(tick_features._flow_by_scans(d, EventOrder(hot=False, density=0.0), spans), [1, 4])
    assert cut.columns == whole.columns
    text = {c: F.round(c, 3).cast("string") for c in whole.columns if c.endswith("m")}
    assert rows(cut.withColumns(text), "sequence", *text) == rows(whole.withColumns(text), "sequence", *text)
    twice = long_key.filter("sequence < 500").withColumn("ts_event", F.expr("ts_event - ts_event % 2000000000"))
    twice = twice.unionByName(twice.filter(at(100, 50)))
    p = twice.toPandas()
    inside = lambda t: p[(p.ts_event <= t) & (p.ts_event >= t - 60_000_000_000)]
    want = sorted(((r.sequence, len(w := inside(r.ts_event)), len(w[["price", "side"]].drop_duplicates())) for r in p.itertuples()), key=str)
    assert rows(tick_features.flow_features(twice, cells, [1]), "sequence", "order_count_1m", "unique_orders_1m") == want


def test_resilience_of_a_long_key_runs_in_cells(spark, pins):
    plain = rows(queries()["liquidity_resilience"](spark, SF), "instrument", "sequence", "recovery_seconds")
    assert not pins
    spark.conf.set("tickloom.wideRows", "20")
    try:
        cut = queries()["liquidity_resilience"](spark, SF)
        assert pins and rows(cut, "instrument", "sequence", "recovery_seconds") == plain
    finally:
        spark.conf.unset("tickloom.wideRows")
