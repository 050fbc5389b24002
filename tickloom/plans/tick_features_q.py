"""Tick feature bundles and time-horizon windows."""

from pyspark.sql import functions as F

from tickloom.operators import horizons as hz
from tickloom.operators import tick_features as tf
from tickloom.order import EventOrder
from tickloom.plans.binding import MBO_SQL, W, mbo, mbo_order, rows, span, strict, trailing
from tickloom.plans.registry import query

_DELTA = "CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END"

BASIC_SQL = f"""t0 AS (SELECT *, {_DELTA} AS delta, coalesce(price - lag(price) OVER ({W}), 0) AS price_change,
      (price - lag(price) OVER ({W})) / lag(price) OVER ({W}) AS ret, row_number() OVER ({W}) AS rn FROM mbo),
    t1 AS (SELECT *, CAST(sum(delta) OVER {span(None, 0)} AS BIGINT) AS cum_delta, CAST(sum(delta) OVER {rows(20)} AS BIGINT) AS imbalance,
      coalesce(stddev_samp(ret) OVER {rows(50)}, 0) AS volatility, size / avg(size) OVER {rows(100)} AS size_norm,
      delta / (coalesce(stddev_samp(size) OVER {rows(100)}, 0) + 1e-6) AS delta_norm,
      CAST(sum(CASE WHEN side = 'B' THEN size ELSE 0 END) OVER {rows(20)} AS BIGINT) AS buy_velocity,
      CAST(sum(CASE WHEN side = 'A' THEN size ELSE 0 END) OVER {rows(20)} AS BIGINT) AS sell_velocity,
      CASE WHEN rn = 1 THEN 0 ELSE delta END AS delta_pressure_gradient,
      sum(price * size) OVER {rows(50)} / sum(size) OVER {rows(50)} AS vwap50,
      sum(price_change) OVER {rows(20)} AS price_mom, CAST(sum(delta) OVER {rows(20)} AS BIGINT) AS delta_mom FROM t0),
    basic AS (SELECT *, CAST(price_change > 0 AS INTEGER) AS direction,
      coalesce((buy_velocity - sell_velocity) / nullif(buy_velocity + sell_velocity, 0), 0) AS bid_ask_imbalance_ratio,
      (price - vwap50) / vwap50 AS vwap_dev, CASE WHEN abs(price_mom) > 1e-9 THEN price_mom ELSE 1.0 END - delta_mom AS mom_divergence FROM t1)"""


@query(
    "rolling_basic_features",
    "instrument sequence direction delta cum_delta imbalance buy_velocity sell_velocity delta_pressure_gradient",
    "price_change volatility size_norm bid_ask_imbalance_ratio vwap50 vwap_dev price_mom mom_divergence",
    f"WITH {MBO_SQL}, {BASIC_SQL} SELECT * FROM basic",
)
def rolling_basic_features(spark, sf):
    m = mbo(spark, sf)
    return tf.basic_features(m, mbo_order(m))


@query(
    "rolling_basic_features_cells",
    "instrument sequence cum_delta imbalance",
    "volatility vwap50 delta_norm",
    f"WITH {MBO_SQL}, {BASIC_SQL} SELECT * FROM basic WHERE rn > 1",
)
def rolling_basic_features_cells(spark, sf):
    """The bundle through fixed-size cells with halos, as for a key too large for a task."""
    from tickloom.order import number_rows

    m = mbo(spark, sf)
    o = EventOrder(hot=True, cell_rows=700)
    out = tf.basic_features(m, o)
    return number_rows(out, o, "rn").filter("rn > 1")


EVENTS_SQL = f"""e0 AS (SELECT *, {_DELTA} AS delta, coalesce(price - lag(price) OVER ({W}), 0) AS chg,
      round(price / greatest((SELECT quantile_cont(abs(price), 0.5) FROM mbo) * 1e-6, 0.01), 2) AS bucket FROM mbo),
    e1 AS (SELECT *, abs(sum(delta) OVER {rows(20)}) AS d20, sum(size) OVER {rows(50)} AS v50, sum(abs(chg)) OVER {rows(20)} + 1e-6 AS mv,
      sum(size) OVER (PARTITION BY instrument, bucket ORDER BY ts_event, sequence ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS refill,
      avg(size) OVER {rows(50)} AS m50, avg(size) OVER {rows(500)} AS m500, abs(sum(delta) OVER {rows(30)}) AS d30,
      sum(chg) OVER {rows(30)} AS p30, coalesce(stddev_samp(price) OVER {rows(50)}, 0) AS sd50,
      sum(CASE WHEN side IN ('A', 'B') THEN size ELSE 0 END) OVER {rows(20)} AS vel FROM e0),
    ev AS (SELECT *, least(greatest(d20 / nullif(v50, 0) / mv, 0), 10) AS absorption_strength, least(greatest(refill / (m50 + 1e-6), 0), 10) AS iceberg_score,
      CAST(d30 > 3 * quantile_cont(d30, 0.5) OVER {rows(200)} AND abs(p30) < sd50 * 0.2 AND coalesce(lead(p30, 10) OVER ({W}), 0) * p30 < 0 AS INTEGER) AS spoofing_flag,
      CAST(vel > 3 * quantile_cont(vel, 0.5) OVER {rows(200)} AS INTEGER) AS aggression_surge, CAST(m50 < m500 * 0.25 AS INTEGER) AS liquidity_void FROM e1)"""


@query(
    "tick_event_signals",
    "instrument sequence spoofing_flag aggression_surge liquidity_void",
    "absorption_strength iceberg_score",
    f"WITH {MBO_SQL}, {EVENTS_SQL} SELECT * FROM ev",
)
def tick_event_signals(spark, sf):
    m = mbo(spark, sf)
    return tf.event_features(m, mbo_order(m))


def flow_sql(m: int) -> str:
    w = trailing(m * 60_000_000_000)
    return f"""SELECT instrument, sequence, sum(size) OVER {w} AS volume, sum(CASE WHEN side = 'B' THEN size ELSE 0 END) OVER {w} AS buy,
      sum(CASE WHEN side = 'A' THEN size ELSE 0 END) OVER {w} AS ask, sum(CASE WHEN action = 'A' THEN size ELSE 0 END) OVER {w} AS added,
      sum(CASE WHEN action = 'C' THEN size ELSE 0 END) OVER {w} AS cancelled, sum(CASE WHEN action = 'F' THEN size ELSE 0 END) OVER {w} AS executed,
      max(price) OVER {w} - min(price) OVER {w} AS rng, stddev_pop(price) OVER {w} AS sd, count(*) OVER {w} AS n,
      len(list_distinct(list((price, side)) OVER {w})) AS uniq FROM mbo"""


@query(
    "rolling_time_flow",
    "instrument sequence volume_60m buy_volume_60m ask_volume_60m net_flow_60m add_volume_60m cancel_volume_60m execute_volume_60m order_count_60m unique_orders_60m",
    "net_flow_ratio_60m price_range_60m price_volatility_60m avg_order_size_60m",
    f"""WITH {MBO_SQL}, f AS ({flow_sql(60)}) SELECT instrument, sequence, CAST(volume AS BIGINT) AS volume_60m, CAST(buy AS BIGINT) AS buy_volume_60m,
      CAST(ask AS BIGINT) AS ask_volume_60m, CAST(buy - ask AS BIGINT) AS net_flow_60m, (buy - ask) / volume AS net_flow_ratio_60m,
      CAST(added AS BIGINT) AS add_volume_60m, CAST(cancelled AS BIGINT) AS cancel_volume_60m, CAST(executed AS BIGINT) AS execute_volume_60m,
      rng AS price_range_60m, sd AS price_volatility_60m, n AS order_count_60m, uniq AS unique_orders_60m, volume / n AS avg_order_size_60m FROM f""",
)
def rolling_time_flow(spark, sf):
    m = mbo(spark, sf).select("instrument", "ts_event", "sequence", "action", "side", "price", "size")
    return tf.flow_features(m, mbo_order(m), [60])


@query(
    "history_momentum",
    "instrument sequence",
    "price_momentum_60r price_momentum_300r volume_ratio price_efficiency large_trade_ratio",
    f"""WITH {MBO_SQL}, h AS (SELECT *, row_number() OVER ({W}) AS rn, price - lag(price) OVER ({W}) AS chg FROM mbo),
    g AS (SELECT *, lag(price, 59) OVER ({W}) AS p60, lag(price, 299) OVER ({W}) AS p300, CASE WHEN rn >= 60 THEN sum(size) OVER {rows(60)} ELSE sum(size) OVER {rows(500)} END AS recent,
      avg(size) OVER {rows(100)} AS m100, abs(sum(chg) OVER {rows(499)}) AS mv, sum(abs(chg)) OVER {rows(499)} AS path,
      sum(CASE WHEN size >= 90 THEN 1 ELSE 0 END) OVER {rows(100)} AS big FROM h)
    SELECT instrument, sequence, CASE WHEN rn >= 10 THEN coalesce((price - p60) / p60, 0) END AS price_momentum_60r,
      CASE WHEN rn >= 10 THEN coalesce((price - p300) / p300, 0) END AS price_momentum_300r, CASE WHEN rn >= 10 THEN recent / m100 END AS volume_ratio,
      CASE WHEN rn >= 10 THEN CASE WHEN path > 0 THEN mv / path ELSE 0 END END AS price_efficiency, CASE WHEN rn >= 10 THEN big / least(rn, 100) END AS large_trade_ratio FROM g""",
)
def history_momentum(spark, sf):
    m = mbo(spark, sf)
    return tf.history_features(m, mbo_order(m), large=90)


def _mean_sd(c: str, minutes: int) -> str:
    w = f"(PARTITION BY instrument ORDER BY ts_event RANGE BETWEEN {minutes * 60_000_000_000 - 1} PRECEDING AND CURRENT ROW)"
    return f"avg({c}) OVER {w} AS {c}_ma_{minutes}m, stddev_samp({c}) OVER {w} AS {c}_std_{minutes}m"


@query(
    "rolling_time_mean_std",
    "instrument sequence",
    "price_ma_15m price_std_15m size_ma_15m size_std_15m price_ma_120m price_std_120m size_ma_120m size_std_120m",
    f"WITH {MBO_SQL} SELECT instrument, sequence, {_mean_sd('price', 15)}, {_mean_sd('size', 15)}, {_mean_sd('price', 120)}, {_mean_sd('size', 120)} FROM mbo",
)
def rolling_time_mean_std(spark, sf):
    m = mbo(spark, sf)
    return tf.time_rolling(m, mbo_order(m), ["price", "size"], (15, 120))


@query(
    "interaction_terms",
    "instrument sequence",
    "price_volume_interaction volatility_volume_interaction",
    f"""WITH {MBO_SQL}, f AS ({flow_sql(5)}) SELECT instrument, sequence, price * volume AS price_volume_interaction, sd * volume AS volatility_volume_interaction
    FROM f JOIN mbo USING (instrument, sequence)""",
)
def interaction_terms(spark, sf):
    m = mbo(spark, sf)
    d = tf.flow_features(m, mbo_order(m), [5]).withColumn("mid_price", F.col("price"))
    return tf.cross_features(d)


FILL_SQL = f"""fl AS (SELECT *, row_number() OVER ({W}) AS n, price - lag(price) OVER ({W}) AS d FROM mbo WHERE action = 'F')"""


@query(
    "trade_price_volume_action",
    "instrument sequence volume_change",
    "price_change price_change_pct price_volatility price_momentum price_acceleration volume_change_pct volume_ma volume_std volume_imbalance volume_momentum volume_acceleration",
    f"""WITH {MBO_SQL}, {FILL_SQL}, x AS (SELECT *, lag(price) OVER ({W}) AS p1, lag(price, 9) OVER ({W}) AS p9, lag(price, 19) OVER ({W}) AS p19, first_value(price) OVER ({W}) AS p0,
      lag(size) OVER ({W}) AS s1, stddev_pop(price) OVER {rows(50)} AS psd, avg(size) OVER {rows(50)} AS vma, stddev_pop(size) OVER {rows(50)} AS vsd,
      sum(CASE WHEN side = 'B' THEN size ELSE 0 END) OVER {rows(10)} AS b, sum(CASE WHEN side = 'A' THEN size ELSE 0 END) OVER {rows(10)} AS a,
      avg(size) OVER {span(-4, 0)} AS m0, avg(size) OVER {span(-9, -5)} AS m5, avg(size) OVER {span(-14, -10)} AS m10 FROM fl)
    SELECT instrument, sequence, coalesce(price - p1, 0) AS price_change, coalesce((price - p1) / p1 * 100, 0) AS price_change_pct,
      CASE WHEN n >= 2 THEN psd ELSE 0 END AS price_volatility, CASE WHEN n >= 10 THEN price - p9 ELSE price - p0 END AS price_momentum,
      CASE WHEN n >= 20 THEN (price - p9) - (p9 - p19) ELSE 0 END AS price_acceleration, coalesce(size - s1, 0) AS volume_change,
      coalesce((size - s1) / s1 * 100, 0) AS volume_change_pct, CASE WHEN n >= 2 THEN vma ELSE 0 END AS volume_ma, CASE WHEN n >= 2 THEN vsd ELSE 0 END AS volume_std,
      CASE WHEN n >= 10 AND a + b > 0 THEN (b - a) / (a + b) ELSE 0 END AS volume_imbalance, CASE WHEN n >= 10 THEN m0 - m5 ELSE 0 END AS volume_momentum,
      CASE WHEN n >= 15 THEN (m0 - m5) - (m5 - m10) ELSE 0 END AS volume_acceleration FROM x""",
)
def trade_price_volume_action(spark, sf):
    m = mbo(spark, sf)
    return tf.trade_features(m, mbo_order(m))


def ema_rec(name: str, src: str, col: str, a: float, adjust: bool = False) -> str:
    """The average by its definition: every earlier row with its own weight."""
    q = f"pow(1 - {a}, m.n - p.n)"
    num = f"sum(p.{col} * {q})" if adjust else f"sum(p.{col} * CASE WHEN p.n = 1 THEN 1 ELSE {a} END * {q})"
    return f"""{name} AS (SELECT m.instrument, m.sequence, {num}{f' / sum({q})' if adjust else ''} AS y
      FROM {src} m JOIN {src} p ON p.instrument = m.instrument AND p.n <= m.n GROUP BY 1, 2)"""


@query(
    "trade_technicals",
    "instrument sequence",
    "rsi macd bollinger_upper bollinger_lower bollinger_position ema_short ema_long",
    f"""WITH {MBO_SQL}, {FILL_SQL}, {ema_rec('e10', 'fl', 'price', 2 / 11)}, {ema_rec('e12', 'fl', 'price', 2 / 13)}, {ema_rec('e20', 'fl', 'price', 2 / 21)}, {ema_rec('e26', 'fl', 'price', 2 / 27)},
    x AS (SELECT *, avg(greatest(d, 0)) FILTER (d IS NOT NULL) OVER {rows(14)} AS g, avg(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER {rows(14)} AS l,
      avg(price) OVER {rows(20)} AS mu, stddev_pop(price) OVER {rows(20)} AS sd FROM fl)
    SELECT instrument, sequence, CASE WHEN n < 20 THEN 0 WHEN l <> 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END AS rsi,
      CASE WHEN n < 26 THEN 0 ELSE e12.y - e26.y END AS macd, CASE WHEN n < 20 THEN 0 ELSE mu + 2 * sd END AS bollinger_upper, CASE WHEN n < 20 THEN 0 ELSE mu - 2 * sd END AS bollinger_lower,
      CASE WHEN n < 20 THEN 0 WHEN sd > 0 THEN (price - (mu - 2 * sd)) / (4 * sd) ELSE 0.5 END AS bollinger_position,
      CASE WHEN n < 20 THEN 0 ELSE e10.y END AS ema_short, CASE WHEN n < 20 THEN 0 ELSE e20.y END AS ema_long
    FROM x JOIN e10 USING (instrument, sequence) JOIN e12 USING (instrument, sequence) JOIN e20 USING (instrument, sequence) JOIN e26 USING (instrument, sequence)""",
)
def trade_technicals(spark, sf):
    m = mbo(spark, sf)
    return tf.trade_features(m, mbo_order(m))


@query(
    "trade_features_on_all_events",
    "instrument sequence",
    "volume_ma price_change",
    f"""WITH {MBO_SQL}, {FILL_SQL}, x AS (SELECT instrument, ts_event, CASE WHEN n >= 2 THEN avg(size) OVER {rows(50)} ELSE 0 END AS volume_ma, coalesce(d, 0) AS price_change FROM fl)
    SELECT m.instrument, m.sequence, coalesce(x.volume_ma, 0) AS volume_ma, coalesce(x.price_change, 0) AS price_change
    FROM mbo m ASOF LEFT JOIN x ON m.instrument = x.instrument AND m.ts_event >= x.ts_event""",
)
def trade_features_on_all_events(spark, sf):
    m = mbo(spark, sf)
    return tf.trade_features(m, mbo_order(m), on_all_events=True)


@query(
    "session_clock",
    "sequence hour minute second is_market_open weekday is_monday is_friday is_weekend",
    "time_decimal session_progress",
    f"""WITH {MBO_SQL}, t AS (SELECT sequence, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second,
      hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE AS time_decimal, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM mbo)
    SELECT *, CAST(time_decimal BETWEEN 9.5 AND 16 AS INTEGER) AS is_market_open, CASE WHEN time_decimal BETWEEN 9.5 AND 16 THEN (time_decimal - 9.5) / 6.5 ELSE 0 END AS session_progress,
      CAST(weekday = 0 AS INTEGER) AS is_monday, CAST(weekday = 4 AS INTEGER) AS is_friday, CAST(weekday >= 5 AS INTEGER) AS is_weekend FROM t""",
)
def session_clock(spark, sf):
    return tf.clock_features(mbo(spark, sf))


def horizon_sql(h: str, ns: int) -> str:
    w = trailing(ns)
    f = "action = 'F'"
    return f"""CAST(sum(CASE WHEN {f} AND side = 'B' THEN size ELSE 0 END) OVER {w} AS BIGINT) AS "{h}_buy_volume",
      CAST(sum(CASE WHEN {f} AND side = 'A' THEN size ELSE 0 END) OVER {w} AS BIGINT) AS "{h}_sell_volume",
      CAST(sum(CASE WHEN {f} THEN size ELSE 0 END) OVER {w} AS BIGINT) AS "{h}_total_volume",
      CAST(sum(CASE WHEN {f} THEN {_DELTA} ELSE 0 END) OVER {w} AS BIGINT) AS "{h}_delta",
      count(*) OVER {w} AS "{h}_events", stddev_pop(price) OVER {w} AS "{h}_volatility" """


_ALL = {h: hz.horizon_ns(h) for h in hz.HORIZONS_MS}
_HCOLS = ["buy_volume", "sell_volume", "total_volume", "delta", "events"]


@query(
    "multi_horizon_delta",
    "instrument sequence " + " ".join(f"{h}_{c}" for h in _ALL for c in _HCOLS),
    "",
    f"WITH {MBO_SQL} SELECT instrument, sequence, {', '.join(horizon_sql(h, ns) for h, ns in _ALL.items())} FROM mbo",
)
def multi_horizon_delta(spark, sf):
    m = mbo(spark, sf)
    return hz.multi_horizon(m, mbo_order(m))


_FEW = {h: hz.horizon_ns(h) for h in ("5m", "20m", "1h")}


@query(
    "multi_horizon_delta_scan",
    "instrument sequence " + " ".join(f"{h}_{c}" for h in _FEW for c in _HCOLS),
    "",
    f"WITH {MBO_SQL} SELECT instrument, sequence, {', '.join(horizon_sql(h, ns) for h, ns in _FEW.items())} FROM mbo",
)
def multi_horizon_delta_scan(spark, sf):
    """The same windows as differences of running sums, the form for dense keys."""
    m = mbo(spark, sf)
    return hz.multi_horizon(m, mbo_order(m), _FEW, method="scan")


_PX = {"20m": hz.horizon_ns("20m"), "1h": hz.horizon_ns("1h")}


@query(
    "horizon_price_and_volatility",
    "instrument sequence",
    "px20 px60 sd20 sd60 dr60",
    f"""WITH {MBO_SQL}, x AS (SELECT instrument, sequence, price, {horizon_sql('20m', _PX['20m'])}, {horizon_sql('1h', _PX['1h'])},
      first_value(price) OVER {trailing(_PX['20m'])} AS f20, first_value(price) OVER {trailing(_PX['1h'])} AS f60 FROM mbo)
    SELECT instrument, sequence, price - f20 AS px20, price - f60 AS px60, "20m_volatility" AS sd20, "1h_volatility" AS sd60,
      CASE WHEN "1h_total_volume" > 0 THEN "1h_delta" / "1h_total_volume" ELSE 0 END AS dr60 FROM x""",
)
def horizon_price_and_volatility(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m)
    d = hz.trailing_price(hz.multi_horizon(m, o, _PX), o, _PX)
    return d.select(
        "instrument", "sequence",
        F.col("20m_price_change").alias("px20"), F.col("1h_price_change").alias("px60"),
        F.col("20m_volatility").alias("sd20"), F.col("1h_volatility").alias("sd60"), F.col("1h_delta_ratio").alias("dr60"),
    )


_CROSS = {h: hz.horizon_ns(h) for h in ("1s", "10s", "1m", "5m", "20m", "1h")}


@query(
    "cross_horizon_ratios",
    "instrument sequence",
    "delta_momentum_1s_1m delta_momentum_1m_20m volume_acceleration_ratio delta_divergence_1s_1h",
    f"""WITH {MBO_SQL}, x AS (SELECT instrument, sequence, {', '.join(horizon_sql(h, ns) for h, ns in _CROSS.items())} FROM mbo)
    SELECT instrument, sequence, CASE WHEN "1m_delta" <> 0 THEN "1s_delta" / "1m_delta" ELSE 0 END AS delta_momentum_1s_1m,
      CASE WHEN "20m_delta" <> 0 THEN "1m_delta" / "20m_delta" ELSE 0 END AS delta_momentum_1m_20m,
      CASE WHEN "1m_total_volume" > 0 AND "5m_total_volume" > 0 THEN ("10s_total_volume" / "1m_total_volume") / ("1m_total_volume" / "5m_total_volume") ELSE 0 END AS volume_acceleration_ratio,
      "1s_delta" / greatest("1s_total_volume", 1) - "1h_delta" / greatest("1h_total_volume", 1) AS delta_divergence_1s_1h FROM x""",
)
def cross_horizon_ratios(spark, sf):
    m = mbo(spark, sf)
    return hz.cross_horizon(hz.multi_horizon(m, mbo_order(m), _CROSS))
