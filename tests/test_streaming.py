"""Streams in several micro-batches give what the batch operators give."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from check_oracle import norm
from support import SF, rows
from tickloom.operators import book, detectors
from tickloom.order import EventOrder
from tickloom.plans import load_all
from tickloom.plans.registry import oracle, plans
from tickloom.streaming import sources as ss
from tickloom.streaming import state as st
from tickloom.streaming import windows as sw

ORDER = EventOrder(hot=False)


def stream(spark, events, folder):
    """Five files in time order, one per trigger."""
    d = spark.createDataFrame(events).withColumn("event_time", F.timestamp_micros(F.expr("ts_event div 1000")))
    for i in range(5):
        d.filter((F.col("sequence") >= 180 * i) & (F.col("sequence") < 180 * (i + 1))).coalesce(1).write.mode("append").parquet(folder)
    return ss.event_files(spark, folder, d.schema, files_per_trigger=1).select(*st.EVENT_COLUMNS)


def test_live_book(spark, frame, events, tmp_path):
    s = stream(spark, events, f"file://{tmp_path}/in")
    live = ss.run_to_table(st.stateful(s, ["instrument"], st.LiveBook()), f"file://{tmp_path}/out")
    batch = book.book_at_events(book.level_book(frame, ORDER), ORDER, 0)
    assert rows(live, "instrument", "sequence", "best_bid", "best_ask") == rows(batch, "instrument", "sequence", "best_bid", "best_ask")


def shuffled(spark, events, folder):
    """Five files; every third row comes one file late, within 0.5 s of the newest."""
    d = spark.createDataFrame(events).withColumn("event_time", F.timestamp_micros(F.expr("ts_event div 1000")))
    part = F.least(F.expr("sequence div 180") + (F.col("sequence") % 3 == 0).cast("int"), F.lit(4))
    for i in range(5):
        d.filter(part == i).orderBy(F.xxhash64("sequence")).coalesce(1).write.mode("append").parquet(folder)
    return ss.event_files(spark, folder, d.schema, files_per_trigger=1).select(*st.EVENT_COLUMNS)


def released(batch, events, late_ms):
    """Rows the watermark has passed at the end."""
    return batch.filter(F.expr(f"ts_event div 1000000 < {int(events.ts_event.max()) // 1_000_000 - late_ms}"))


def test_icebergs(spark, frame, events, tmp_path):
    s = shuffled(spark, events, f"file://{tmp_path}/in")
    p = st.IcebergCandidates(20, 3, 50_000_000)
    live = ss.run_to_table(st.stateful(s, ["instrument", "price"], p, late="500 milliseconds"), f"file://{tmp_path}/out")
    batch = released(detectors.icebergs(frame, ORDER, 20, 3, 50_000_000), events, 500)
    cols = ["instrument", "sequence", "replenishment_count", "visible_size"]
    assert batch.count() > 0
    assert rows(live, *cols) == rows(batch, *cols)


def test_book_of_shuffled_arrivals(spark, frame, events, tmp_path):
    s = shuffled(spark, events, f"file://{tmp_path}/in")
    live = ss.run_to_table(st.stateful(s, ["instrument"], st.LiveBook(), late="500 milliseconds"), f"file://{tmp_path}/out")
    batch = released(book.book_at_events(book.level_book(frame, ORDER), ORDER, 0), events, 500)
    assert batch.count() > 0
    assert rows(live, "instrument", "sequence", "best_bid", "best_ask") == rows(batch, "instrument", "sequence", "best_bid", "best_ask")


def test_bars_cut_by_batches_are_merged(spark, events, tmp_path):
    base = spark.createDataFrame(events).withColumn("event_time", F.timestamp_micros(F.expr("ts_event div 1000")))
    half = F.col("sequence") % 2 == 0
    for part in (base.filter(half), base.filter(~half)):
        sw.bar_parts(part, "100 milliseconds").write.mode("append").parquet(f"file://{tmp_path}/parts")
    merged = sw.merged_bars(spark.read.parquet(f"file://{tmp_path}/parts"))
    whole = sw.merged_bars(sw.bar_parts(base, "100 milliseconds"))
    cols = ["instrument", "bar_start", "open", "high", "low", "close", "volume"]
    assert rows(merged, *cols) == rows(whole, *cols)


def test_late_rows_go_to_the_side(spark, events, tmp_path):
    base = spark.createDataFrame(events).withColumn("event_time", F.timestamp_micros(F.expr("ts_event div 1000")))
    now = base.agg(F.max("event_time")).first()[0]
    folder = f"file://{tmp_path}/in"
    base.coalesce(1).write.parquet(f"{folder}/a")
    old = base.limit(5).withColumn("event_time", F.lit(now) - F.expr("INTERVAL 2 HOURS"))
    router = sw.LateRouter(f"file://{tmp_path}/out", 3600)
    router(base, 0)
    router(old, 1)
    assert spark.read.parquet(f"file://{tmp_path}/out/late").count() == 5
    assert spark.read.parquet(f"file://{tmp_path}/out/on_time").count() == len(events)


class Held:
    """State and timers of one key in memory; ``read`` lists what was fetched by key."""

    def __init__(self):
        self.value, self.rows, self.timers, self.read = None, {}, [], []

    def getMapState(self, name, *schemas):
        return self

    getValueState = getMapState

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        self.read.append(key)
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


class Echo(st.Released):
    output = "ts_event long, sequence long"

    def init(self, handle):
        self.wait(handle)

    def close(self):
        pass

    def apply(self, key, pdf):
        yield pdf[["ts_event", "sequence"]]


def test_a_timer_reads_only_the_stretches_that_are_due():
    held, p = Held(), Echo()
    p.timed = True
    p.init(held)
    ms = [5, 12_000, 3, 55_000, 12_500, 17_000, 3, 91_000, 14_000]
    given = pd.DataFrame({"ts_event": [m * 1_000_000 + 7 for m in ms], "sequence": range(len(ms)), "action": "A", "side": [None] * len(ms), "order_id": "x", "price": 1.5, "size": 3})
    list(p.handleInputRows(("I",), iter([given[:4], given[4:6]]), Clock(0)))
    list(p.handleInputRows(("I",), iter([given[6:]]), Clock(0)))
    assert held.timers == [4, 4] and sorted(held.rows) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (5, 0), (9, 0)]
    out = lambda mark: [tuple(r) for f in p.handleExpiredTimer(("I",), Clock(mark), None) for r in f.itertuples(index=False)]
    assert [q for _, q in out(14_000)] == [2, 6, 0, 1, 4]  # 14,000 is not yet passed
    assert {b for b, _ in held.read} == {0, 1} and sorted(held.rows) == [(1, 0), (5, 0), (9, 0)]
    assert held.timers[-1] == 14_001
    assert out(14_000) == [] and len(held.rows) == 3
    held.read.clear()
    assert [q for _, q in out(60_000)] == [8, 5, 3]
    assert held.read == [(1, 0), (5, 0)] and held.timers[-1] == 91_001
    assert [q for _, q in out(100_000)] == [7] and held.rows == {} and held.value is None


load_all()
ALL = [n for n in plans() if n.startswith("stream_")]


@pytest.mark.parametrize("name", ALL)
def test_the_end_of_the_input_is_released(spark, tmp_path, name):
    """A table shorter than the lateness gives what the SQL says of all its rows."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    squeezed = F.timestamp_micros(F.expr("1700000000000000 + unix_micros(CAST(ts AS timestamp)) % 2592000000000 div 6000"))  # thirty days in seven minutes
    events.withColumn("ts", squeezed.cast(events.schema["ts"].dataType)).coalesce(1).write.parquet(f"{tmp_path}/sf/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/sf/events.parquet/*.parquet'")
    cur = con.execute(oracle()[name])
    got = plans()[name](spark, f"{tmp_path}/sf").select(*[d[0] for d in cur.description]).collect()
    want = cur.fetchall()
    assert want
    assert sorted((tuple(map(norm, r)) for r in got), key=str) == sorted((tuple(map(norm, r)) for r in want), key=str)
