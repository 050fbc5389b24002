"""Windows over dense clocks are not read row by row, and rows that come twice stay two."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from support import rows
from tickloom.operators import horizons, tick_features
from tickloom.order import EventOrder

NS = 60_000_000_000


@pytest.fixture(scope="module")
def odd(spark, events):
    """A minute holds some twenty rows; clocks tie, lie before 1970 or are missing."""
    early = events.assign(ts_event=(events.ts_event - events.ts_event.min()) * 3000 - 400 * NS, price=events.price.where(events.sequence % 7 > 0))
    d = spark.createDataFrame(early.astype({"ts_event": "int64"})).withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    return d.withColumn("ts_event", F.when(F.col("sequence") % 90 != 5, F.col("ts_event"))).cache()


@pytest.mark.parametrize("hot", [False, True])
def test_flow_without_frames(spark, odd, monkeypatch, hot):
    cols = ["instrument", "sequence", "price_range_1m", "price_range_9m", "unique_orders_1m", "unique_orders_9m", "order_count_9m"]
    plain = tick_features.flow_features(odd, EventOrder(hot=False, density=0.0), [1, 9])
    def no_frame(*a):
        raise AssertionError("a dense window was read by a frame")

    monkeypatch.setattr(tick_features, "time_windowed", no_frame)
    monkeypatch.setattr(horizons, "time_windowed", no_frame)
    dense = tick_features.flow_features(odd, EventOrder(hot=hot, density=1.0, cell_rows=70), [1, 9])
    assert rows(dense, *cols) == rows(plain, *cols)


def test_rows_that_come_twice_stay_two(spark, events):
    twice = spark.createDataFrame(pd.concat([events, events[100:140]]))
    cols = ["instrument", "sequence", "h_n", "h_events"]
    by = lambda how: rows(horizons.trailing(twice, EventOrder(hot=False), {"n": F.col("size")}, {"h": 30_000_000}, how), *cols)
    assert len(by("scan")) == len(events) + 40 and by("scan") == by("frame")
