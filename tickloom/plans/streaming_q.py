"""Streaming queries: the supplied events replayed as a file stream."""

from pyspark.sql import functions as F

from tickloom.plans.binding import MBO_SQL, W, mbo, mbo_of, rows, span, table
from tickloom.plans.book_q import ALL_SQL
from tickloom.plans.registry import REGISTRY, query
from tickloom.plans.tick_features_q import BASIC_SQL
from tickloom.session import scratch_path
from tickloom.streaming import sources as ss
from tickloom.streaming import state as st
from tickloom.streaming import windows as sw


FILES = 5
FILE_ROWS = 500_000
STATE_ROWS = 100_000
LATE, LATE_S = "10 minutes", 600
HOUR, HOUR_S = "1 hour", 3_600


def arrivals(spark, sf, delayed, late_s=None):
    """The events in ``FILES`` stretches of time, one a trigger, each in shuffled order in
    files of about ``FILE_ROWS`` rows; rows for which ``delayed(id, microseconds to the
    stretch's end)`` holds arrive with the next stretch.

    With ``late_s`` one file more closes the input: a copy of the newest row, dated further
    ahead than the allowed lateness. The watermark then passes every event, but never this
    row, so it waits until the end and is in no result of a processor that ``Released`` feeds."""
    events = table(spark, sf, "events")
    folder = scratch_path(spark, "arrivals")
    n, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    low, high, count = events.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    files = max(1, -(-count // (FILES * FILE_ROWS)))  # a stretch is a trigger, and many tasks where it is large
    width = max((high or 0) - (low or 0), 1) // FILES + 1
    since = at - F.lit(low or 0)
    stretch = F.floor((since - since % width) / width)
    part = F.least(stretch + delayed(n, width - since % width).cast("int"), F.lit(FILES - 1))
    for i in range(FILES):
        mixed = events.where(part == i).repartition(files, F.xxhash64(n)).sortWithinPartitions(F.xxhash64(n))
        mixed.write.mode("append").parquet(folder)
    if late_s is not None and high is not None:
        ahead = F.timestamp_micros(F.lit(high + (late_s + 1) * 1_000_000)).cast(events.schema["ts"].dataType)
        events.where(at == high).limit(1).withColumn("ts", ahead).write.mode("append").parquet(folder)
    raw = ss.event_files(spark, folder, events.schema, files_per_trigger=files)
    return mbo_of(raw).withColumn("event_time", F.timestamp_micros(F.expr("ts_event div 1000")))


def stream(spark, sf, late_s=None):
    """Half the rows of a stretch's last five minutes are late by one file: state crosses
    batches and the order of events has to be restored, within the allowed lateness."""
    return arrivals(spark, sf, lambda n, left: (n % 2 == 0) & (left <= 5 * 60_000_000), late_s)


def done(df, name, mode="append", partitions=None):
    return ss.run_to_table(df, scratch_path(df.sparkSession, name), mode, partitions)


def state_partitions(spark, sf):
    """One for every ``STATE_ROWS`` events, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "events").count() // STATE_ROWS))


@query(
    "stream_footprint_bars",
    "instrument start_us volume delta",
    "open high low close",
    f"""WITH {MBO_SQL} SELECT instrument, epoch_us(time_bucket(INTERVAL 60 MINUTE, ts)) AS start_us, arg_min(price, (ts_event, sequence)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_event, sequence)) AS close,
      CAST(sum(size) AS BIGINT) AS volume, CAST(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS BIGINT) AS delta FROM mbo GROUP BY instrument, time_bucket(INTERVAL 60 MINUTE, ts)""",
)
def stream_footprint_bars(spark, sf):
    out = done(sw.stream_bars(stream(spark, sf, HOUR_S + LATE_S), "60 minutes", "10 minutes"), "bars")
    return out.withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "stream_sliding_flow",
    "instrument start_us volume delta events",
    "",
    f"""WITH {MBO_SQL}, w AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM mbo)
    SELECT instrument, epoch_us(b) AS start_us, CAST(sum(size) AS BIGINT) AS volume, CAST(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS BIGINT) AS delta, count(*) AS events FROM w GROUP BY instrument, b""",
)
def stream_sliding_flow(spark, sf):
    out = done(sw.stream_sliding(stream(spark, sf, HOUR_S + LATE_S), "60 minutes", "30 minutes", "10 minutes"), "sliding")
    return out.withColumn("start_us", F.unix_micros("window_start"))


@query(
    "stream_sessions",
    "instrument start_us events volume",
    "",
    f"""WITH {MBO_SQL}, g AS (SELECT *, CASE WHEN ts_event - lag(ts_event) OVER ({W}) < 3600000000000 THEN 0 ELSE 1 END AS brk FROM mbo), s AS (SELECT *, sum(brk) OVER {span(None, 0)} AS sid FROM g)
    SELECT instrument, epoch_us(min(ts)) AS start_us, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume FROM s GROUP BY instrument, sid""",
)
def stream_sessions(spark, sf):
    out = done(sw.stream_sessions(stream(spark, sf, HOUR_S + LATE_S), "60 minutes", "10 minutes"), "sessions")
    return out.withColumn("start_us", F.unix_micros("session_start"))


@query(
    "stream_latest_quotes",
    "instrument last_size last_side rows",
    "last_price",
    f"""WITH {MBO_SQL} SELECT instrument, arg_max(price, (ts_event, sequence)) AS last_price, arg_max(size, (ts_event, sequence)) AS last_size, arg_max(side, (ts_event, sequence)) AS last_side, count(*) AS "rows" FROM mbo GROUP BY 1""",
)
def stream_latest_quotes(spark, sf):
    out = done(sw.latest_quotes(stream(spark, sf)), "quotes", "update")
    newest = out.groupBy("instrument").agg(F.max("batch_id").alias("batch_id"))
    return out.join(newest, ["instrument", "batch_id"])


@query(
    "stream_live_book",
    "instrument sequence bid_size ask_size",
    "best_bid best_ask",
    f"WITH {ALL_SQL} SELECT instrument, sequence, best_bid, best_ask, CAST(bid_size AS BIGINT) AS bid_size, CAST(ask_size AS BIGINT) AS ask_size FROM bk",
)
def stream_live_book(spark, sf):
    s = stream(spark, sf, LATE_S).select(*st.EVENT_COLUMNS)
    return done(st.stateful(s, ["instrument"], st.LiveBook(), late=LATE), "book", partitions=state_partitions(spark, sf))


@query(
    "stream_spoofing",
    "instrument sequence placed_size time_to_cancel",
    "spoofing_score",
    f"""WITH {MBO_SQL}, a AS (SELECT *, count(*) FILTER (action = 'A') OVER (PARTITION BY instrument, order_id ORDER BY ts_event, sequence ROWS UNBOUNDED PRECEDING) AS life FROM mbo),
    l AS (SELECT *, first_value(ts_event) OVER w AS t0, first_value(size) OVER w AS s0 FROM a WINDOW w AS (PARTITION BY instrument, order_id, life ORDER BY ts_event, sequence))
    SELECT instrument, sequence, s0 AS placed_size, ts_event - t0 AS time_to_cancel, least(1, (259200000000000 - (ts_event - t0)) / 259200000000000) AS spoofing_score FROM l WHERE action = 'C' AND life > 0 AND s0 >= 20 AND ts_event - t0 <= 259200000000000""",
)
def stream_spoofing(spark, sf):
    s = stream(spark, sf, HOUR_S).select(*st.EVENT_COLUMNS, st.order_share().alias("share"))
    p = st.OrderLives(20, 259_200_000_000_000, 30 * 86_400_000)
    return done(st.stateful(s, ["instrument", "share"], p, late=HOUR), "spoofs", partitions=state_partitions(spark, sf))


@query(
    "stream_icebergs",
    "instrument sequence replenishment_count visible_size",
    "confidence_score",
    REGISTRY["iceberg_events"].sql,
)
def stream_icebergs(spark, sf):
    s = stream(spark, sf, HOUR_S).select(*st.EVENT_COLUMNS)
    p = st.IcebergCandidates(30, 3, 86_400_000_000_000)
    return done(st.stateful(s, ["instrument", "price"], p, late=HOUR), "icebergs", partitions=state_partitions(spark, sf))


@query(
    "stream_rolling_tail",
    "instrument sequence direction rows",
    "price_change delta cum_delta imbalance volatility size_norm delta_norm buy_size sell_size buy_velocity sell_velocity bid_ask_imbalance_ratio"
    " delta_pressure_gradient vwap50 vwap_dev price_mom delta_mom mom_divergence",
    f"""WITH {MBO_SQL}, {BASIC_SQL} SELECT * EXCLUDE (cum_delta), sum(delta) OVER {rows(512)} AS cum_delta, CASE side WHEN 'B' THEN size ELSE 0 END AS buy_size,
      CASE side WHEN 'A' THEN size ELSE 0 END AS sell_size, count(*) OVER {rows(512)} AS "rows" FROM basic""",
)
def stream_rolling_tail(spark, sf):
    s = stream(spark, sf, LATE_S).select(*st.EVENT_COLUMNS)
    return done(st.stateful(s, ["instrument"], st.RollingTail(512), late=LATE), "tail", partitions=state_partitions(spark, sf))


@query(
    "stream_signal_changes",
    "instrument sequence side previous",
    "",
    f"WITH {MBO_SQL}, l AS (SELECT *, lag(side) OVER ({W}) AS previous FROM mbo) SELECT instrument, sequence, side, previous FROM l WHERE previous <> side",
)
def stream_signal_changes(spark, sf):
    s = stream(spark, sf, LATE_S).select(*st.EVENT_COLUMNS)
    return done(st.stateful(s, ["instrument"], st.SignalChanges(), late=LATE), "signals", partitions=state_partitions(spark, sf))


@query(
    "stream_json_ticks",
    "side symbol",
    "price size",
    f"""WITH {MBO_SQL} SELECT CASE WHEN sequence % 5 = 0 THEN 'buy' ELSE CASE WHEN side = 'B' THEN 'buy' ELSE 'sell' END END AS side, instrument AS symbol, CASE WHEN sequence % 7 = 0 THEN 0 ELSE price END AS price, CASE WHEN sequence % 3 = 0 THEN 1 ELSE size END AS size FROM mbo""",
)
def stream_json_ticks(spark, sf):
    """JSON messages with missing fields, written as text and read back as a stream."""
    path = scratch_path(spark, "json")
    m = mbo(spark, sf)
    q = F.col("sequence")
    msg = F.to_json(
        F.struct(
            (F.col("ts_event") / 1e9).alias("ts"), F.col("instrument").alias("symbol"),
            F.when(q % 7 != 0, F.col("price")).alias("price"), F.when(q % 3 != 0, F.col("size")).alias("size"),
            F.when(q % 5 != 0, F.when(F.col("side") == "B", "buy").otherwise("sell")).alias("side"),
        )
    )
    m.select(msg.alias("value")).write.text(path)
    return done(ss.with_status(ss.json_tick_files(spark, path)), "ticks")


@query(
    "stream_recent_rows",
    "instrument sequence side size",
    "price",
    f"WITH {MBO_SQL} SELECT instrument, sequence, side, size, price FROM mbo QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts_event DESC, sequence DESC) <= 512",
)
def stream_recent_rows(spark, sf):
    """The newest 512 rows of every instrument, kept from batch to batch."""
    recent = sw.RecentRows(scratch_path(spark, "recent"), 512, ["instrument"], ["ts_event", "sequence"])
    return recent.run(stream(spark, sf).select(*st.EVENT_COLUMNS))


@query(
    "stream_first_rows",
    "instrument sequence side size",
    "price",
    f"WITH {MBO_SQL} SELECT instrument, sequence, side, size, price FROM mbo ORDER BY ts_event, sequence LIMIT 700",
)
def stream_first_rows(spark, sf):
    """The first 700 rows to arrive; the stream ends by itself."""
    s = arrivals(spark, sf, lambda n, left: F.lit(False)).select(*st.EVENT_COLUMNS)
    return sw.FirstRows(scratch_path(spark, "first"), 700, ["ts_event", "sequence"]).run(s)


@query(
    "stream_status",
    "batches rows",
    "last_price",
    f"WITH {MBO_SQL} SELECT {FILES} AS batches, count(*) AS \"rows\", arg_max(price, (ts_event, sequence)) AS last_price FROM mbo",
)
def stream_status(spark, sf):
    """Counters of a running query, read from its progress."""
    s = ss.with_status(stream(spark, sf), order=("event_time", "sequence"))
    path = scratch_path(spark, "status")
    q = ss.to_files(s.select(*st.EVENT_COLUMNS), f"{path}/data", f"{path}/_checkpoint")
    q.awaitTermination()
    told = ss.status(q)
    return spark.createDataFrame([(told["batches"], told["rows"], told["last_price"])], "batches int, rows long, last_price double")


@query(
    "stream_late_side_output",
    "kind sequence",
    "",
    f"""WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events),
    b AS (SELECT *, us - min(us) OVER () AS since, (max(us) OVER () - min(us) OVER ()) // {FILES} + 1 AS width FROM e),
    p AS (SELECT *, least(since // width + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END, {FILES - 1}) AS part FROM b),
    c AS (SELECT part, max(max(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM p GROUP BY part)
    SELECT CASE WHEN us < newest - 3600000000 THEN 'late' ELSE 'on_time' END AS kind, event_id AS sequence FROM p JOIN c USING (part)""",
)
def stream_late_side_output(spark, sf):
    """One row in fifty comes a file late: those over an hour behind go to the side."""
    path = scratch_path(spark, "late")
    s = arrivals(spark, sf, lambda n, left: n % 50 == 7)
    q = s.writeStream.foreachBatch(sw.LateRouter(path, 3600)).option("checkpointLocation", f"{path}/_cp")
    q.trigger(availableNow=True).start().awaitTermination()
    kinds = [spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("kind"), "sequence") for k in ("on_time", "late")]
    return kinds[0].union(kinds[1])


@query(
    "stream_batch_features",
    "instrument start_us volume",
    "close",
    f"""WITH {MBO_SQL} SELECT instrument, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) AS start_us, CAST(sum(size) AS BIGINT) AS volume, arg_max(price, (ts_event, sequence)) AS close FROM mbo GROUP BY 1, 2""",
)
def stream_batch_features(spark, sf):
    path = scratch_path(spark, "perbatch")
    sw.per_batch(stream(spark, sf), lambda b: sw.bar_parts(b, "15 minutes"), path, f"{path}-cp").awaitTermination()
    return sw.merged_bars(spark.read.parquet(path)).withColumn("start_us", F.unix_micros("bar_start"))
