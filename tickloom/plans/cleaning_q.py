"""Canonical columns, filters and normalisation."""

from pyspark.sql import functions as F

from tickloom.functions import canonical as can
from tickloom.operators import filters, normalise
from tickloom.order import EventOrder, Frames, windowed
from tickloom.plans.binding import MBO_SQL, TICK, W, mbo, mbo_order, rows, table
from tickloom.plans.registry import query

_WORDS = "CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'M' WHEN 'view' THEN 'D' WHEN 'purchase' THEN 'EXECUTE' ELSE '?' END"
_SIDES = "CASE user_id % 5 WHEN 0 THEN 'buy' WHEN 1 THEN 'S' WHEN 2 THEN 'ASK' WHEN 3 THEN 'B' ELSE 'x' END"


@query(
    "canonical_codes",
    "action side action_text side_text events",
    "",
    f"""WITH raw AS (SELECT {_WORDS} AS a, {_SIDES} AS s FROM events),
    c AS (SELECT CASE a WHEN 'add' THEN 'A' WHEN 'M' THEN 'M' WHEN 'D' THEN 'C' WHEN 'EXECUTE' THEN 'F' ELSE 'N' END AS action,
      CASE s WHEN 'buy' THEN 'B' WHEN 'B' THEN 'B' WHEN 'S' THEN 'A' WHEN 'ASK' THEN 'A' ELSE 'N' END AS side FROM raw)
    SELECT action, side, CASE action WHEN 'A' THEN 'Add order to book' WHEN 'M' THEN 'Modify existing order'
        WHEN 'C' THEN 'Cancel order from book' WHEN 'F' THEN 'Order filled (resting)' ELSE 'No action (flags/info only)' END AS action_text,
      CASE side WHEN 'B' THEN 'Buy/Bid' WHEN 'A' THEN 'Ask/Sell' ELSE 'No side specified' END AS side_text, count(*) AS events
    FROM c GROUP BY ALL""",
)
def canonical_codes(spark, sf):
    e = table(spark, sf, "events").select(
        can.canonical_action(F.expr(_WORDS)).alias("action"), can.canonical_side(F.expr(_SIDES)).alias("side")
    )
    e = e.groupBy("action", "side").agg(F.count(F.lit(1)).alias("events"))
    return e.withColumns({"action_text": can.action_text("action"), "side_text": can.side_text("side")})


@query(
    "fixed_point_prices",
    "event_id back",
    "price either",
    """WITH x AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 9223372036854775807
        ELSE CAST(round(value * 100) AS BIGINT) * 10000000 END AS fixed FROM events)
    SELECT event_id, CASE WHEN fixed = 9223372036854775807 THEN NULL ELSE CAST(fixed AS DECIMAL(38, 0)) / 1000000000 END AS price,
      fixed AS back, CASE WHEN fixed > 0 AND fixed < 100000 THEN fixed ELSE fixed / 1e9 END AS either FROM x""",
    digits=6,
)
def fixed_point_prices(spark, sf):
    fixed = F.when(F.col("event_id") % 50 == 0, F.lit(can.UNDEF_PRICE)).otherwise(
        F.round(F.col("value") * 100).cast("long") * 10_000_000
    )
    x = table(spark, sf, "events").select("event_id", fixed.alias("fixed"))
    x = x.withColumns({"price": can.price_from_fixed("fixed"), "either": can.price_of_either_unit("fixed")})
    return x.withColumn("back", can.price_to_fixed("price"))


@query(
    "clock_conversions",
    "event_id us back first_clock",
    "",
    """SELECT event_id, CASE WHEN event_id % 70 = 0 THEN NULL ELSE epoch_us(ts) END AS us,
      CASE WHEN event_id % 70 = 0 THEN NULL ELSE epoch_us(ts) * 1000 END AS back,
      CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) * 1000 + 500 ELSE epoch_us(ts) * 1000 END AS first_clock FROM events""",
)
def clock_conversions(spark, sf):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    e = table(spark, sf, "events").select("event_id", ns.alias("ns"))
    undefined = F.lit(str(can.UNDEF_TIMESTAMP)).cast("decimal(20,0)")
    raw = F.when(F.col("event_id") % 70 == 0, undefined).otherwise(F.col("ns").cast("decimal(20,0)"))
    e = e.withColumns(
        {
            "at": can.timestamp_from_ns(raw),
            "ts_event": F.when(F.col("event_id") % 3 != 0, F.col("ns")),
            "ts_recv": F.col("ns") + 500,
        }
    )
    return e.withColumns(
        {"us": F.unix_micros("at"), "back": can.ns_from_timestamp("at"), "first_clock": can.first_clock(e)}
    )


@query(
    "flag_columns",
    "sequence is_last is_tob is_snapshot is_mbp bad_ts_recv maybe_bad_book publisher_specific reserved",
    "",
    f"""WITH {MBO_SQL} SELECT sequence, flags & 128 <> 0 AS is_last, flags & 64 <> 0 AS is_tob, flags & 32 <> 0 AS is_snapshot,
      flags & 16 <> 0 AS is_mbp, flags & 8 <> 0 AS bad_ts_recv, flags & 4 <> 0 AS maybe_bad_book,
      flags & 2 <> 0 AS publisher_specific, flags & 1 <> 0 AS reserved FROM mbo""",
)
def flag_columns(spark, sf):
    return mbo(spark, sf).withColumns(can.flag_columns())


@query(
    "flag_descriptions",
    "text events",
    "",
    f"""WITH {MBO_SQL} SELECT coalesce(nullif(concat_ws('; ', CASE WHEN flags & 128 <> 0 THEN 'Last record in event' END,
      CASE WHEN flags & 64 <> 0 THEN 'Top-of-book message' END, CASE WHEN flags & 32 <> 0 THEN 'Snapshot/replay data' END,
      CASE WHEN flags & 16 <> 0 THEN 'Aggregated price level' END, CASE WHEN flags & 8 <> 0 THEN 'Bad receive timestamp' END,
      CASE WHEN flags & 4 <> 0 THEN 'Possible book gap' END, CASE WHEN flags & 2 <> 0 THEN 'Publisher-specific' END), ''),
      'No special flags') AS text, count(*) AS events FROM mbo GROUP BY 1""",
)
def flag_descriptions(spark, sf):
    m = mbo(spark, sf).withColumn("text", can.flag_text())
    return m.groupBy("text").agg(F.count(F.lit(1)).alias("events"))


@query(
    "event_defaults_and_coercion",
    "event_id ts_event ts_recv action side size sequence flags order_id instrument",
    "price",
    """SELECT event_id, epoch_us(ts) * 1000 AS ts_event, epoch_us(ts) * 1000 AS ts_recv,
      'N' AS action, CASE WHEN event_type = 'view' THEN 'A' WHEN event_type = 'click' THEN 'B' ELSE 'N' END AS side,
      CASE WHEN event_id % 9 = 0 THEN 0 ELSE user_id END AS size, 0::BIGINT AS sequence, 0 AS flags, '0' AS order_id,
      'UNKNOWN' AS instrument, value AS price FROM events""",
)
def event_defaults_and_coercion(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_event"),
        F.col("value").alias("price"),
        F.when(F.col("event_id") % 9 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("size"),
        F.when(F.col("event_type") == "view", "sell").when(F.col("event_type") == "click", "BID").alias("side"),
    )
    return can.canonicalise(e)


@query(
    "aligned_rows",
    "sequence side",
    "",
    f"""WITH {MBO_SQL} SELECT sequence, CASE WHEN sequence % 11 = 0 THEN 'N' ELSE side END AS side FROM mbo WHERE sequence % 13 <> 0""",
)
def aligned_rows(spark, sf):
    m = mbo(spark, sf)
    broken = m.withColumns(
        {
            "ts_event": F.when(F.col("sequence") % 13 != 0, F.col("ts_event")),
            "side": F.when(F.col("sequence") % 11 == 0, "?").otherwise(F.col("side")),
        }
    )
    return can.align(broken)


@query(
    "executions_to_ticks",
    "instrument sequence side order_id",
    "ts price size",
    f"""WITH {MBO_SQL} SELECT instrument, sequence, ts_event / 1e9 AS ts, price, size,
      CASE WHEN side = 'B' THEN 'buy' ELSE 'sell' END AS side, order_id FROM mbo WHERE action = 'F'""",
    digits=6,
)
def executions_to_ticks(spark, sf):
    return can.executions(mbo(spark, sf))


@query(
    "message_ticks",
    "side symbol",
    "ts price size",
    """SELECT epoch_us(ts) / 1e6 AS ts, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS price, 1.0 AS size,
      coalesce(CASE WHEN event_type = 'click' THEN 'sell' END, 'buy') AS side, '' AS symbol FROM events""",
    digits=6,
)
def message_ticks(spark, sf):
    e = table(spark, sf, "events").select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("price"),
        F.when(F.col("event_type") == "click", "sell").alias("side"),
    )
    return can.tick_from_message(e)


# All supplied events fall in January, when New York is five hours behind UTC.
_NY = "(ts - INTERVAL 5 HOUR)::TIME"


@query(
    "tick_filter_trading_hours",
    "instrument sequence ts_event",
    "",
    f"WITH {MBO_SQL} SELECT instrument, sequence, ts_event FROM mbo WHERE {_NY} BETWEEN TIME '09:30:00' AND TIME '16:00:00'",
)
def tick_filter_trading_hours(spark, sf):
    return filters.trading_hours(mbo(spark, sf))


@query(
    "timeframe_presets",
    "name events volume",
    "",
    f"""WITH {MBO_SQL}, p(name, a, b) AS (VALUES ('extended_day', TIME '09:00:00', TIME '16:30:00'),
      ('full_day', TIME '00:00:00', TIME '23:59:00'), ('business', TIME '08:00:00', TIME '17:00:00'), ('regular', TIME '09:30:00', TIME '16:00:00'))
    SELECT name, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume FROM mbo, p WHERE {_NY} BETWEEN a AND b GROUP BY 1""",
)
def timeframe_presets(spark, sf):
    # one pass: each event carries the names of the ranges it falls in
    m = mbo(spark, sf)
    names = F.array_compact(
        F.array(*[F.when(filters.in_hours(a, b), F.lit(n)) for n, (a, b) in filters.TIMEFRAMES.items()])
    )
    return (
        m.select("size", F.explode(names).alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("volume"))
    )


@query(
    "timeframe_stats",
    "total_rows kept_rows dropped_rows",
    "kept_pct",
    f"""WITH {MBO_SQL}, c AS (SELECT count(*) AS total_rows, count(*) FILTER ({_NY} BETWEEN TIME '08:00:00' AND TIME '17:00:00') AS kept_rows FROM mbo)
    SELECT *, total_rows - kept_rows AS dropped_rows, kept_rows / total_rows * 100 AS kept_pct FROM c""",
)
def timeframe_stats(spark, sf):
    return filters.timeframe_stats(mbo(spark, sf), *filters.TIMEFRAMES["business"])


@query(
    "trailing_minutes",
    "sequence ts_event",
    "",
    f"WITH {MBO_SQL} SELECT sequence, ts_event FROM mbo WHERE ts_event >= (SELECT max(ts_event) FROM mbo) - 1440 * 60000000000",
)
def trailing_minutes(spark, sf):
    return filters.last_minutes(mbo(spark, sf), 1440)


@query(
    "session_minute_chunk",
    "sequence ts_event",
    "",
    f"""WITH {MBO_SQL} SELECT sequence, ts_event FROM mbo WHERE ts_event >= epoch_us(TIMESTAMP '2024-01-10 14:30:00') * 1000 + 30 * 60000000000
      AND ts_event < epoch_us(TIMESTAMP '2024-01-10 14:30:00') * 1000 + 150 * 60000000000""",
)
def session_minute_chunk(spark, sf):
    return filters.minute_chunk(mbo(spark, sf), "2024-01-10", 30, 120)


@query(
    "session_labels",
    "session sessions events",
    "",
    f"""WITH {MBO_SQL}, h AS (SELECT hour(ts) AS h FROM mbo)
    SELECT CASE WHEN h < 8 THEN 'asia' WHEN h < 16 THEN 'london' WHEN h < 21 THEN 'new_york' ELSE 'overnight' END AS session,
      CASE WHEN h < 8 THEN 'asia' WHEN h < 13 THEN 'london' WHEN h < 16 THEN 'london,new_york' WHEN h < 21 THEN 'new_york' ELSE 'overnight' END AS sessions,
      count(*) AS events FROM h GROUP BY 1, 2""",
)
def session_labels(spark, sf):
    m = mbo(spark, sf).select(
        filters.session_label().alias("session"), F.array_join(filters.session_labels(), ",").alias("sessions")
    )
    return m.groupBy("session", "sessions").agg(F.count(F.lit(1)).alias("events"))


@query(
    "storage_narrowing",
    "flags_type user_type size_sum",
    "",
    f"""WITH {MBO_SQL} SELECT CASE WHEN max(flags) < 128 THEN 'tinyint' ELSE 'smallint' END AS flags_type,
      CASE WHEN max(user_id) < 128 THEN 'tinyint' WHEN max(user_id) < 32768 THEN 'smallint' ELSE 'int' END AS user_type,
      CAST(sum(size) AS BIGINT) AS size_sum FROM mbo""",
)
def storage_narrowing(spark, sf):
    n = can.narrowed(mbo(spark, sf))
    types = dict(n.dtypes)
    return n.agg(
        F.lit(types["flags"]).alias("flags_type"), F.lit(types["user_id"]).alias("user_type"), F.sum("size").alias("size_sum")
    )


@query(
    "complete_rows",
    "event_id",
    "price",
    "SELECT event_id, value AS price FROM events WHERE event_type <> 'view'",
)
def complete_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("price"))
    return can.drop_incomplete(e)


@query(
    "null_policy_carry",
    "instrument sequence",
    "x",
    f"""WITH {MBO_SQL} SELECT instrument, sequence, coalesce(last_value(CASE WHEN action = 'F' THEN price END IGNORE NULLS) OVER
      (PARTITION BY instrument ORDER BY ts_event, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS x FROM mbo""",
)
def null_policy_carry(spark, sf):
    m = mbo(spark, sf)
    x = F.when(F.col("action") == "F", F.col("price")).when(F.col("action") == "C", F.lit(float("inf")))
    return can.fill_gaps(m.withColumn("x", x), mbo_order(m), ["x"])


@query(
    "null_policy_median",
    "instrument sequence",
    "price_x y",
    f"""WITH {MBO_SQL}, v AS (SELECT instrument, sequence, ts_event, CASE WHEN action <> 'M' THEN price END AS px, CASE WHEN action <> 'C' THEN size END AS y FROM mbo)
    SELECT instrument, sequence, coalesce(last_value(px IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts_event, sequence
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS price_x, coalesce(y, (SELECT quantile_cont(y, 0.5) FROM v)) AS y FROM v""",
)
def null_policy_median(spark, sf):
    m = mbo(spark, sf)
    v = m.withColumns(
        {
            "price_x": F.when(F.col("action") != "M", F.col("price")),
            "y": F.when(F.col("action") != "C", F.col("size").cast("double")),
        }
    )
    return can.impute(v, mbo_order(m), ["price_x"], ["y"])


@query(
    "column_subsets",
    "instrument sequence action",
    "price",
    f"WITH {MBO_SQL} SELECT instrument, sequence, action, price FROM mbo",
)
def column_subsets(spark, sf):
    keep = can.unique_columns(["instrument", "sequence"], ["action", "sequence"], ["price", "instrument"])
    return mbo(spark, sf).select(*keep)


@query(
    "side_by_side_columns",
    "instrument sequence action side size",
    "price notional",
    f"WITH {MBO_SQL} SELECT instrument, sequence, action, side, size, price, price * size AS notional FROM mbo",
)
def side_by_side_columns(spark, sf):
    """Two feature tables that share columns, put side by side; a name that repeats comes from the first."""
    m = mbo(spark, sf)
    left = m.select("instrument", "sequence", "action", "price", "size")
    right = m.select("instrument", "sequence", "side", (F.col("price") + 1).alias("price"), (F.col("price") * F.col("size")).alias("notional"))
    return can.side_by_side([left, right], ["instrument", "sequence"])


MID_SQL = f"""mid AS (SELECT *, avg(price) OVER {rows(20)} AS mid FROM mbo)"""


def with_mid(spark, sf):
    """A stand-in mid price: the mean of the last 20 prices."""
    m = mbo(spark, sf)
    o = mbo_order(m)

    def body(d, f: Frames):
        return d.withColumn("mid", F.avg("price").over(f.rows(20)))

    return windowed(m, o, body, before=20), o


_SIZE_SQL = f"""ln(1 + size) / ln(1 + greatest(CASE WHEN count(*) OVER {rows(1000)} > 1 THEN avg(size) OVER {rows(1000)} ELSE 1 END, 1))"""
_GAP_SQL = f"""gaps AS (SELECT *, coalesce(ts_event - lag(ts_event) OVER ({W}), 0) / 1e9 AS gap FROM mid)"""
_TIME_SQL = f"""CASE WHEN stddev_pop(gap) OVER {rows(1000)} > 1e-12 THEN (gap - avg(gap) OVER {rows(1000)}) / stddev_pop(gap) OVER {rows(1000)} ELSE 0 END"""


@query(
    "normalise_tick_relative",
    "instrument sequence",
    "price_norm size_norm time_delta_norm",
    f"""WITH {MBO_SQL}, {MID_SQL}, {_GAP_SQL} SELECT instrument, sequence, (price - mid) / {TICK} AS price_norm,
      {_SIZE_SQL} AS size_norm, {_TIME_SQL} AS time_delta_norm FROM gaps""",
)
def normalise_tick_relative(spark, sf):
    d, o = with_mid(spark, sf)
    return normalise.normalise_events(d, o, TICK)


@query(
    "normalise_log_relative",
    "instrument sequence",
    "price_norm back",
    f"""WITH {MBO_SQL}, {MID_SQL} SELECT instrument, sequence, ln(price / mid) AS price_norm, price AS back FROM mid""",
    digits=6,
)
def normalise_log_relative(spark, sf):
    d, o = with_mid(spark, sf)
    d = normalise.normalise_events(d, o, TICK, mode="log")
    return d.withColumn("back", normalise.log_absolute("price_norm", "mid"))


_Z = f"""CASE WHEN stddev_pop(mid) OVER {rows(1000)} > 0 THEN (price - avg(mid) OVER {rows(1000)}) / stddev_pop(mid) OVER {rows(1000)} ELSE 0 END"""
_MM = f"""CASE WHEN max(mid) OVER {rows(1000)} > min(mid) OVER {rows(1000)} THEN (price - min(mid) OVER {rows(1000)})
      / (max(mid) OVER {rows(1000)} - min(mid) OVER {rows(1000)}) ELSE 0.5 END"""


@query(
    "normalise_zscore_squashed",
    "instrument sequence",
    "price_norm size_norm",
    f"WITH {MBO_SQL}, {MID_SQL} SELECT instrument, sequence, tanh({_Z}) AS price_norm, tanh({_SIZE_SQL}) AS size_norm FROM mid",
)
def normalise_zscore_squashed(spark, sf):
    d, o = with_mid(spark, sf)
    return normalise.normalise_events(d, o, TICK, mode="zscore")


@query(
    "normalise_minmax_squashed",
    "instrument sequence",
    "price_norm",
    f"WITH {MBO_SQL}, {MID_SQL} SELECT instrument, sequence, tanh({_MM}) AS price_norm FROM mid",
)
def normalise_minmax_squashed(spark, sf):
    d, o = with_mid(spark, sf)
    return normalise.normalise_events(d, o, TICK, mode="minmax")


@query(
    "normalise_inverse",
    "instrument sequence",
    "tick_back z_back minmax_back",
    f"""WITH {MBO_SQL}, {MID_SQL} SELECT instrument, sequence, price AS tick_back,
      CASE WHEN stddev_pop(mid) OVER {rows(1000)} > 0 THEN price ELSE avg(mid) OVER {rows(1000)} END AS z_back,
      CASE WHEN max(mid) OVER {rows(1000)} > min(mid) OVER {rows(1000)} THEN price ELSE min(mid) OVER {rows(1000)} END AS minmax_back FROM mid""",
)
def normalise_inverse(spark, sf):
    d, o = with_mid(spark, sf)

    def body(x, f: Frames):
        x = normalise.with_history(x, f, "mid", "h")
        mean, sd, lo, hi = (F.col(f"h_{k}") for k in ("mean", "sd", "lo", "hi"))
        p = F.col("price")
        return x.withColumns(
            {
                "tick_back": normalise.tick_absolute(normalise.tick_relative(p, "mid", TICK), "mid", TICK),
                "z_back": normalise.zscore_absolute(normalise.zscore(p, mean, sd), mean, sd),
                "minmax_back": normalise.minmax_absolute(normalise.minmax(p, lo, hi), lo, hi),
            }
        )

    return windowed(d, o, body, before=1000)


@query(
    "normalise_imbalance",
    "instrument trade_date",
    "imbalance",
    f"""WITH {MBO_SQL}, s AS (SELECT instrument, trade_date, coalesce(sum(size) FILTER (side = 'B'), 0) AS b, coalesce(sum(size) FILTER (side = 'A'), 0) AS a FROM mbo GROUP BY 1, 2)
    SELECT instrument, trade_date, CASE WHEN a + b > 0 THEN (b - a) / (a + b) ELSE 0 END AS imbalance FROM s""",
)
def normalise_imbalance(spark, sf):
    s = mbo(spark, sf).groupBy("instrument", "trade_date").agg(
        F.sum(F.when(F.col("side") == "B", F.col("size")).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("side") == "A", F.col("size")).otherwise(0)).alias("a"),
    )
    return s.withColumn("imbalance", normalise.imbalance(F.col("b"), F.col("a")))


EMA_SQL = """{name} AS (
      SELECT m.instrument, m.sequence, sum(p.{col} * CASE WHEN p.rn = 1 THEN 1 ELSE {a} END * pow(1 - {a}, m.rn - p.rn)) AS y
      FROM num m JOIN num p ON p.instrument = m.instrument AND p.rn <= m.rn GROUP BY 1, 2)"""


@query(
    "mid_price_averages",
    "instrument sequence",
    "mid_fast mid_medium mid_slow",
    f"""WITH {MBO_SQL}, num AS (SELECT instrument, sequence, price / 3 AS price, row_number() OVER ({W}) AS rn FROM mbo),
    {EMA_SQL.format(name='f', col='price', a=0.1)}, {EMA_SQL.format(name='m', col='price', a=0.01)}, {EMA_SQL.format(name='s', col='price', a=0.001)}
    SELECT instrument, sequence, f.y AS mid_fast, m.y AS mid_medium, s.y AS mid_slow
    FROM f JOIN m USING (instrument, sequence) JOIN s USING (instrument, sequence)""",
)
def mid_price_averages(spark, sf):
    m = mbo(spark, sf)
    return normalise.mid_averages(m.withColumn("third", F.col("price") / 3), mbo_order(m), "third")


@query(
    "session_reset_zscore",
    "instrument sequence",
    "z",
    f"""WITH {MBO_SQL} SELECT instrument, sequence, CASE WHEN stddev_pop(price) OVER w > 0 THEN (price - avg(price) OVER w) / stddev_pop(price) OVER w ELSE 0 END AS z
    FROM mbo WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY ts_event, sequence ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def session_reset_zscore(spark, sf):
    m = mbo(spark, sf)
    o = EventOrder(keys=("instrument", "trade_date")).measured(m)

    def body(d, f: Frames):
        d = normalise.with_history(d, f, "price", "h")
        return d.withColumn("z", normalise.zscore(F.col("price"), F.col("h_mean"), F.col("h_sd")))

    return windowed(m, o, body, before=1000)


@query(
    "robust_and_standard_scaling",
    "sequence",
    "price_scaled size_scaled",
    f"""WITH {MBO_SQL} SELECT sequence, (price - (SELECT quantile_cont(price, 0.5) FROM mbo)) /
        (SELECT quantile_cont(price, 0.75) - quantile_cont(price, 0.25) FROM mbo) AS price_scaled,
      (size - (SELECT avg(size) FROM mbo)) / (SELECT stddev_pop(size) FROM mbo) AS size_scaled FROM mbo""",
)
def robust_and_standard_scaling(spark, sf):
    m = mbo(spark, sf)
    return normalise.standard_scaled(normalise.robust_scaled(m, ["price"]), ["size"])


@query(
    "weighted_global_score",
    "sequence",
    "score",
    f"""WITH {MBO_SQL}, b AS (SELECT min(price) p0, max(price) p1, min(size) s0, max(size) s1 FROM mbo)
    SELECT sequence, least(greatest(0.7 * (price - p0) / (p1 - p0 + 1e-8) + 0.3 * (size - s0) / (s1 - s0 + 1e-8), 0), 1) AS score FROM mbo, b""",
)
def weighted_global_score(spark, sf):
    return normalise.scored(mbo(spark, sf), {"price": 0.7, "size": 0.3})


@query(
    "depth_log_arrays",
    "instrument trade_date level",
    "depth",
    f"""WITH {MBO_SQL}, d AS (SELECT instrument, trade_date, unnest([2, 1, 0]) AS level, unnest([sum(size), count(*), 0]) AS x FROM mbo GROUP BY 1, 2)
    SELECT instrument, trade_date, 2 - level AS level, CASE WHEN x > 0 THEN ln(1 + x) ELSE 0 END AS depth FROM d""",
)
def depth_log_arrays(spark, sf):
    d = mbo(spark, sf).groupBy("instrument", "trade_date").agg(
        F.array(F.sum("size"), F.count(F.lit(1)), F.lit(0).cast("long")).alias("depths")
    )
    d = d.withColumn("depths", normalise.depth_log("depths"))
    return d.select("instrument", "trade_date", F.posexplode("depths").alias("level", "depth"))
