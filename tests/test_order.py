"""Plain and cell forms give the same results, whatever the partitioning."""

import pytest
from pyspark.sql import functions as F

from support import rows
from tickloom.functions.ema import ema, reach
from tickloom.operators import horizons as hz
from tickloom.order import EventOrder, number_rows, running, time_windowed, windowed

PLAIN = EventOrder(hot=False)
CELLS = EventOrder(hot=True, cell_rows=50)


@pytest.mark.parametrize("parts", [1, 7, 23])
def test_row_numbers(frame, parts):
    d = frame.repartition(parts)
    assert rows(number_rows(d, PLAIN), "sequence", "_rn") == rows(number_rows(d, CELLS), "sequence", "_rn")


def test_measured_picks_cells_for_a_large_key(spark, frame):
    spark.conf.set("tickloom.hotKeyRows", "500")
    try:
        assert EventOrder().measured(frame).hot is True
        assert EventOrder(keys=("instrument", "price")).measured(frame).hot is False
    finally:
        spark.conf.unset("tickloom.hotKeyRows")


def test_windowed_with_halo(frame):
    def body(d, f):
        d = d.withColumn("m", F.avg("price").over(f.rows(9)))
        return d.withColumns({"mm": F.stddev_samp("m").over(f.rows(5)), "ahead": F.lead("size", 3).over(f.ordered())})

    a, b = (windowed(frame, o, body, before=14, after=3) for o in (PLAIN, CELLS))
    assert rows(a, "sequence", "mm", "ahead") == rows(b, "sequence", "mm", "ahead")


def test_running_scans(frame):
    fills = F.when(F.col("action") == "F", F.col("price"))
    scans = {
        "s": ("sum", "size"), "c": ("count", fills), "lo": ("min", "price"), "hi": ("max", "price"),
        "l": ("last", fills), "f": ("first", fills), "x": ("sum", "size"), "xl": ("last", fills),
    }
    a, b = (running(frame, o, scans, exclusive=("x", "xl")) for o in (PLAIN, CELLS))
    assert rows(a, "sequence", *scans) == rows(b, "sequence", *scans)


def test_time_windowed(frame):
    def body(d, f):
        return d.withColumn("hi", F.max("price").over(f.trailing(20_000_000)))

    a, b = (time_windowed(frame, o, body, 20_000_000) for o in (PLAIN, CELLS))
    assert rows(a, "sequence", "hi") == rows(b, "sequence", "hi")


@pytest.mark.parametrize("order", [PLAIN, CELLS])
def test_trailing_scan_equals_frame(frame, order):
    h = {"a": 5_000_000, "b": 60_000_000}
    cols = ["sequence", "a_v", "a_events", "b_v", "b_events"]
    by_frame = hz.trailing(frame, PLAIN, {"v": "size"}, h, "frame")
    by_scan = hz.trailing(frame, order, {"v": "size"}, h, "scan")
    assert rows(by_frame, *cols) == rows(by_scan, *cols)


@pytest.mark.parametrize("adjust", [True, False])
def test_ema_matches_pandas(spark, events, adjust):
    d = spark.createDataFrame(events)

    def body(x, f):
        return ema(x, f, {"e": ("price", 0.2, adjust)})

    got = {r["sequence"]: r["e"] for r in windowed(d, CELLS, body, before=reach(0.2)).collect()}
    for _, g in events.groupby("instrument"):
        want = g.sort_values("sequence")["price"].ewm(alpha=0.2, adjust=adjust).mean()
        assert max(abs(got[s] - w) for s, w in zip(g["sequence"], want)) < 1e-9
