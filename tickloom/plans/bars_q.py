"""Bars and footprints."""

from pyspark.sql import functions as F

from tickloom.operators import bars
from tickloom.plans.binding import MBO_SQL, TICK, mbo, ticks
from tickloom.plans.registry import query


def bar_sql(minutes: int, source: str = "mbo") -> str:
    return f"""SELECT instrument, time_bucket(INTERVAL {minutes} MINUTE, ts) AS bar_start,
      arg_min(price, (ts_event, sequence)) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, (ts_event, sequence)) AS close, CAST(sum(size) AS BIGINT) AS volume,
      CAST(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS BIGINT) AS delta
    FROM {source} GROUP BY 1, 2"""


@query(
    "footprint_minute",
    "instrument start_us volume delta",
    "open high low close delta_ratio",
    f"""WITH {MBO_SQL}, b AS ({bar_sql(1)})
    SELECT *, epoch_us(bar_start) AS start_us,
      CASE WHEN volume <> 0 THEN delta / volume ELSE 0 END AS delta_ratio FROM b""",
)
def footprint_minute(spark, sf):
    return bars.footprint(mbo(spark, sf), 1).withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "footprint_gap_filled",
    "instrument start_us volume delta",
    "open close delta_ratio",
    f"""WITH {MBO_SQL}, b AS ({bar_sql(60)}),
    r AS (SELECT instrument, min(bar_start) lo, max(bar_start) hi FROM b GROUP BY 1),
    g AS (SELECT instrument, unnest(generate_series(lo, hi, INTERVAL 60 MINUTE)) AS bar_start FROM r)
    SELECT g.instrument, epoch_us(g.bar_start) AS start_us, open, close, coalesce(volume, 0) AS volume,
      coalesce(delta, 0) AS delta, coalesce(CASE WHEN volume <> 0 THEN delta / volume ELSE 0 END, 0) AS delta_ratio
    FROM g LEFT JOIN b USING (instrument, bar_start)""",
)
def footprint_gap_filled(spark, sf):
    return bars.footprint(mbo(spark, sf), 60, keep_empty=True).withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "footprint_clipped",
    "instrument start_us",
    "delta_norm",
    f"""WITH {MBO_SQL}, b AS ({bar_sql(5)})
    SELECT instrument, epoch_us(bar_start) AS start_us,
      coalesce(least(greatest(delta / nullif(volume, 0), -1), 1), 0) AS delta_norm FROM b""",
)
def footprint_clipped(spark, sf):
    b = bars.clipped_delta(bars.footprint(mbo(spark, sf), 5))
    return b.withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "ohlcv_bars",
    "instrument start_us volume",
    "open high low close",
    f"WITH {MBO_SQL}, b AS ({bar_sql(15)}) SELECT *, epoch_us(bar_start) AS start_us FROM b",
)
def ohlcv_bars(spark, sf):
    return bars.ohlcv(mbo(spark, sf), "15 minutes").withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "ohlcv_daily_trades",
    "instrument start_us volume",
    "open high low close",
    """WITH t AS (SELECT 'S' || l_suppkey AS instrument, l_shipdate AS ts, epoch_us(l_shipdate) * 1000 AS ts_event,
        l_orderkey * 10 + l_linenumber AS sequence, l_extendedprice / l_quantity AS price,
        CAST(l_quantity AS BIGINT) AS size FROM lineitem)
    SELECT instrument, epoch_us(date_trunc('day', ts)) AS start_us, arg_min(price, (ts_event, sequence, price)) AS open,
      max(price) AS high, min(price) AS low, arg_max(price, (ts_event, sequence, price)) AS close,
      CAST(sum(size) AS BIGINT) AS volume FROM t GROUP BY 1, 2""",
    digits=8,
)
def ohlcv_daily_trades(spark, sf):
    # (order, line) pairs repeat in the supplied table, so price is the last tie-break
    t = ticks(spark, sf).withColumn("sequence", F.struct("sequence", "price"))
    return bars.ohlcv(t, "1 day").withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "ohlcv_of_fills",
    "instrument start_us",
    "open high low close volume",
    f"""WITH {MBO_SQL}, f AS (SELECT * FROM mbo WHERE action = 'F'), b AS ({bar_sql(5, 'f')})
    SELECT *, epoch_us(bar_start) AS start_us FROM b""",
)
def ohlcv_of_fills(spark, sf):
    return bars.ohlcv_of_fills(mbo(spark, sf), "5 minutes").withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "ohlc_epoch_bars",
    "instrument time",
    "open high low close",
    f"WITH {MBO_SQL}, b AS ({bar_sql(60)}) SELECT *, CAST(epoch(bar_start) AS BIGINT) AS time FROM b",
)
def ohlc_epoch_bars(spark, sf):
    return bars.ohlc_epoch(mbo(spark, sf), "60 minutes")


@query(
    "footprint_price_grid",
    "instrument start_us level buy_volume sell_volume delta",
    "",
    f"""WITH {MBO_SQL} SELECT instrument, epoch_us(time_bucket(INTERVAL 60 MINUTE, ts)) AS start_us,
      CAST(round(price / 0.25) AS BIGINT) AS level,
      CAST(sum(CASE WHEN side = 'B' THEN size ELSE 0 END) AS BIGINT) AS buy_volume,
      CAST(sum(CASE WHEN side = 'A' THEN size ELSE 0 END) AS BIGINT) AS sell_volume,
      CAST(sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS BIGINT) AS delta
    FROM mbo GROUP BY 1, 2, 3""",
)
def footprint_price_grid(spark, sf):
    return bars.footprint_grid(mbo(spark, sf), "60 minutes", TICK).withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "volume_profile_bins",
    "instrument bin volume up_volume down_volume",
    "bin_low",
    f"""WITH {MBO_SQL}, b AS ({bar_sql(60)}),
    r AS (SELECT instrument, min(low) AS lo, (max(high) - min(low)) / 20.0 AS step FROM b GROUP BY 1),
    bins AS (SELECT *, unnest(range(20)) AS bin FROM r)
    SELECT b.instrument, CAST(bin AS BIGINT) AS bin, min(lo + bin * step) AS bin_low,
      CAST(sum(volume) AS BIGINT) AS volume,
      CAST(sum(CASE WHEN close >= open THEN volume ELSE 0 END) AS BIGINT) AS up_volume,
      CAST(sum(CASE WHEN close >= open THEN 0 ELSE volume END) AS BIGINT) AS down_volume
    FROM b JOIN bins ON b.instrument = bins.instrument
      AND bin BETWEEN greatest(ceil((low - lo) / step) - 1, 0) AND least(floor((high - lo) / step), 19)
    GROUP BY 1, 2""",
)
def volume_profile_bins(spark, sf):
    return bars.volume_profile(bars.ohlcv(mbo(spark, sf), "60 minutes"))


@query(
    "volume_onto_bars",
    "instrument start_us volume",
    "close",
    f"""WITH {MBO_SQL}, b AS ({bar_sql(30)}),
    v AS (SELECT instrument, time_bucket(INTERVAL 30 MINUTE, ts) AS bar_start, CAST(sum(size) AS BIGINT) AS fv
          FROM mbo WHERE action = 'F' GROUP BY 1, 2)
    SELECT b.instrument, epoch_us(b.bar_start) AS start_us, close, coalesce(fv, 0) AS volume
    FROM b LEFT JOIN v USING (instrument, bar_start)""",
)
def volume_onto_bars(spark, sf):
    m = mbo(spark, sf)
    b = bars.ohlcv(m, "30 minutes").drop("volume")
    v = bars.ohlcv(m.filter("action = 'F'"), "30 minutes").select("instrument", "bar_start", "volume")
    return bars.volume_onto_bars(b, v, ["instrument", "bar_start"]).withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "bar_summary",
    "instrument bars up_bars down_bars doji_bars volume",
    "return_pct high low volatility_pct",
    f"""WITH {MBO_SQL}, b AS ({bar_sql(60)}),
    c AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY bar_start) AS prev FROM b)
    SELECT instrument, count(*) AS bars,
      (arg_max(close, bar_start) - arg_min(open, bar_start)) / arg_min(open, bar_start) * 100 AS return_pct,
      max(high) AS high, min(low) AS low, CAST(sum(volume) AS BIGINT) AS volume,
      count(*) FILTER (close > open) AS up_bars, count(*) FILTER (close < open) AS down_bars,
      count(*) FILTER (close = open) AS doji_bars,
      stddev_samp((close - prev) / prev) * sqrt(252) * 100 AS volatility_pct
    FROM c GROUP BY 1""",
)
def bar_summary(spark, sf):
    return bars.bar_summary(bars.ohlcv(mbo(spark, sf), "60 minutes"))
