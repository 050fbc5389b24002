"""Quote, bar and signal bundles, feature sets and user functions."""

import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions import batches as ub
from tickloom.operators import bars, bundles as bu
from tickloom.plans.bars_q import bar_sql
from tickloom.plans.binding import MBO_SQL, W, mbo, mbo_order, rows, strict
from tickloom.plans.registry import query
from tickloom.plans.tick_features_q import ema_rec
from tickloom.session import scratch_path

_Q = f"""q AS (SELECT *, (price - 0.125 * (1 + sequence % 3)) AS bp, (price + 0.125 * (1 + sequence % 2)) AS ap, size AS bs, flags + 1 AS asz, row_number() OVER ({W}) AS n FROM mbo),
    m AS (SELECT *, (bp + ap) / 2 AS mid, ap - bp AS sp, bs + asz AS tv FROM q), c AS (SELECT *, mid - lag(mid) OVER ({W}) AS pc FROM m)"""


def quotes(spark, sf):
    m = mbo(spark, sf)
    s = F.col("sequence")
    return m.withColumns(
        {
            "bid_price": F.col("price") - 0.125 * (1 + s % 3), "ask_price": F.col("price") + 0.125 * (1 + s % 2),
            "bid_size": F.col("size"), "ask_size": (F.col("flags") + 1).cast("long"),
        }
    ), mbo_order(m)


@query(
    "quote_features",
    "instrument sequence total_volume volume_imbalance volume_change price_levels_i spread_ticks_i hour is_market_open volume_lag_3",
    "mid_price spread spread_bps volume_ratio price_change price_change_pct price_acceleration sma_5 sma_20 volatility_20 realized_volatility price_lag_10 price_std_10 spread_mean_5",
    f"""WITH {MBO_SQL}, {_Q} SELECT instrument, sequence, mid AS mid_price, sp AS spread, sp / mid * 10000 AS spread_bps, tv AS total_volume, CAST(bs - asz AS BIGINT) AS volume_imbalance, bs / (asz + 1e-8) AS volume_ratio, pc AS price_change, pc / (mid - pc) AS price_change_pct,
      pc - lag(pc) OVER ({W}) AS price_acceleration, CAST(tv - lag(tv) OVER ({W}) AS BIGINT) AS volume_change, CAST(round_even(mid / (mid * 0.0001), 0) AS BIGINT) AS price_levels_i, CAST(round_even(sp / (mid * 0.0001), 0) AS BIGINT) AS spread_ticks_i, CAST(hour(ts) AS INTEGER) AS hour,
      CAST(hour(ts) >= 9 AND hour(ts) < 16 AS INTEGER) AS is_market_open, {strict('avg({c})', 'mid', 5)} AS sma_5, {strict('avg({c})', 'mid', 20)} AS sma_20, {strict('stddev_samp({c})', 'pc', 20)} AS volatility_20,
      sqrt(sum(pc * pc) OVER {rows(20)}) AS realized_volatility, lag(mid, 10) OVER ({W}) AS price_lag_10, CAST(lag(tv, 3) OVER ({W}) AS BIGINT) AS volume_lag_3, {strict('stddev_samp({c})', 'mid', 10)} AS price_std_10, {strict('avg({c})', 'sp', 5)} AS spread_mean_5
    FROM c QUALIFY n >= 21""",
    digits=6,
)
def quote_features(spark, sf):
    d = bu.quote_features(*quotes(spark, sf))
    return d.withColumns({"price_levels_i": F.col("price_levels").cast("long"), "spread_ticks_i": F.col("spread_ticks").cast("long")})


@query(
    "quote_macd",
    "instrument sequence",
    "ema_12 ema_26 macd",
    f"""WITH {MBO_SQL}, {_Q}, {ema_rec('a', 'm', 'mid', 2 / 13, True)}, {ema_rec('z', 'm', 'mid', 2 / 27, True)} SELECT instrument, sequence, a.y AS ema_12, z.y AS ema_26, a.y - z.y AS macd
    FROM m JOIN a USING (instrument, sequence) JOIN z USING (instrument, sequence) WHERE n >= 21""",
    digits=6,
)
def quote_macd(spark, sf):
    return bu.quote_features(*quotes(spark, sf))


_BW = "PARTITION BY instrument ORDER BY bar_start"


def _bstrict(agg: str, c: str, n: int) -> str:
    return strict(agg, c, n, _BW)


@query(
    "bar_technicals",
    "instrument start_us",
    "price_change high_low_ratio close_open_ratio price_vs_sma_5 price_vs_sma_10 price_vs_sma_20 rsi bb_position volume_ratio volatility macd",
    f"""WITH {MBO_SQL}, b AS ({bar_sql(60)}), x AS (SELECT *, row_number() OVER ({_BW}) AS n, close - lag(close) OVER ({_BW}) AS chg, bar_start AS sequence FROM b),
    {ema_rec('a', 'x', 'close', 2 / 13, True)}, {ema_rec('z', 'x', 'close', 2 / 27, True)},
    y AS (SELECT *, avg(CASE WHEN chg > 0 THEN chg ELSE 0 END) OVER {rows(14, _BW)} AS g, avg(CASE WHEN chg < 0 THEN -chg ELSE 0 END) OVER {rows(14, _BW)} AS l, {_bstrict('avg({c})', 'close', 20)} AS mu, {_bstrict('stddev_samp({c})', 'close', 20)} AS sd, chg / lag(close) OVER ({_BW}) AS price_change,
      close / ({_bstrict('avg({c})', 'close', 5)}) - 1 AS price_vs_sma_5, close / ({_bstrict('avg({c})', 'close', 10)}) - 1 AS price_vs_sma_10, volume / ({_bstrict('avg({c})', 'volume', 20)}) AS volume_ratio FROM x)
    SELECT y.instrument, epoch_us(y.bar_start) AS start_us, price_change, high / low AS high_low_ratio, close / open AS close_open_ratio, price_vs_sma_5, price_vs_sma_10, close / mu - 1 AS price_vs_sma_20,
      CASE WHEN n >= 14 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END END AS rsi, (close - (mu - 2 * sd)) / (4 * sd) AS bb_position, volume_ratio, sd AS volatility, a.y - z.y AS macd
    FROM y JOIN a ON y.instrument = a.instrument AND y.bar_start = a.sequence JOIN z ON y.instrument = z.instrument AND y.bar_start = z.sequence""",
    digits=6,
)
def bar_technicals(spark, sf):
    b = bu.bar_technicals(bars.ohlcv(mbo(spark, sf), "60 minutes"))
    return b.withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "direction_features",
    "instrument sequence price_direction",
    "price_direction_ma momentum_60r momentum_300r momentum_900r volatility_60r volatility_300r trend_strength trend_consistency",
    f"""WITH {MBO_SQL}, d AS (SELECT *, CASE WHEN price > lag(price) OVER ({W}) THEN 1 ELSE -1 END AS pd FROM mbo), x AS (SELECT *, coalesce({strict('avg({c})', 'pd', 5)}, 0) AS ma, list(pd) OVER {rows(10)} AS l FROM d)
    SELECT instrument, sequence, pd AS price_direction, ma AS price_direction_ma, {', '.join(f"coalesce((price - lag(price, {k}) OVER ({W})) / lag(price, {k}) OVER ({W}), 0) AS momentum_{k}r" for k in (60, 300, 900))},
      coalesce({strict('stddev_samp({c})', 'price', 60)}, 0) AS volatility_60r, coalesce({strict('stddev_samp({c})', 'price', 300)}, 0) AS volatility_300r, abs(ma) AS trend_strength,
      CASE WHEN len(l) >= 10 THEN len([v for v in l if v = l[1]]) / 10 ELSE 0 END AS trend_consistency FROM x""",
    digits=7,
)
def direction_features(spark, sf):
    m = mbo(spark, sf)
    return bu.direction_features(m, mbo_order(m))


@query(
    "pattern_signals",
    "instrument sequence large_buy_orders large_sell_orders iceberg_signal order_block_signal absorption_signal level_volume",
    "volume_imbalance_ma volume_imbalance_std low_impact_volume level_volume_ma iceberg_confidence order_block_confidence absorption_confidence",
    f"""WITH {MBO_SQL}, d AS (SELECT *, CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END AS vi, coalesce(abs((price - lag(price) OVER ({W})) / lag(price) OVER ({W})), 0) AS imp, {strict('quantile_cont({c}, 0.95)', 'size', 100)} AS q95,
      CASE WHEN price > lag(price) OVER ({W}) THEN 1 ELSE -1 END AS dr, CAST(sum(size) OVER (PARTITION BY instrument, round(price, 2)) AS BIGINT) AS lv FROM mbo),
    x AS (SELECT *, coalesce({strict('avg({c})', 'lv', 50)}, 0) AS lm, lag(dr) OVER ({W}) AS pdr FROM d),
    s AS (SELECT *, CAST(abs(vi) > 0.3 AND imp < 0.001 AS INTEGER) AS iceberg_signal, CAST(lv > lm * 2 AND imp > 0.002 AS INTEGER) AS order_block_signal, CAST(imp > 0.003 AND (pdr IS NULL OR pdr <> dr) AS INTEGER) AS absorption_signal FROM x)
    SELECT instrument, sequence, CAST(coalesce(side = 'B' AND size > q95, false) AS INTEGER) AS large_buy_orders, CAST(coalesce(side = 'A' AND size > q95, false) AS INTEGER) AS large_sell_orders, iceberg_signal, order_block_signal, absorption_signal, lv AS level_volume,
      coalesce({strict('avg({c})', 'vi', 20)}, 0) AS volume_imbalance_ma, coalesce({strict('stddev_samp({c})', 'vi', 20)}, 0) AS volume_imbalance_std, size * (1 - imp) AS low_impact_volume, lm AS level_volume_ma, abs(vi) * (1 - imp) * iceberg_signal AS iceberg_confidence,
      lv / CASE WHEN lm = 0 THEN 1 ELSE lm END * imp * order_block_signal AS order_block_confidence, imp * absorption_signal AS absorption_confidence FROM s""",
    digits=8,
)
def pattern_signals(spark, sf):
    m = mbo(spark, sf)
    return bu.pattern_signals(m, mbo_order(m))


@query(
    "fallback_features",
    "instrument sequence is_buy is_sell side_imbalance",
    "price_ma_5 price_ma_10 size_ma_5 size_ma_10 price_change side_imbalance_ma",
    f"""WITH {MBO_SQL}, d AS (SELECT *, CAST(side = 'B' AS INTEGER) AS is_buy, CAST(side = 'A' AS INTEGER) AS is_sell, CAST(side = 'B' AS INTEGER) - CAST(side = 'A' AS INTEGER) AS side_imbalance FROM mbo)
    SELECT *, {', '.join(f"coalesce({strict('avg({c})', c, n)}, 0) AS {c}_ma_{n}" for c in ('price', 'size') for n in (5, 10))}, coalesce(price - lag(price) OVER ({W}), 0) AS price_change2, coalesce({strict('avg({c})', 'side_imbalance', 5)}, 0) AS side_imbalance_ma FROM d""".replace(
        "price_change2", "price_change"
    ),
    digits=6,
)
def fallback_features(spark, sf):
    m = mbo(spark, sf)
    return bu.fallback_features(m, mbo_order(m))


_CORE = ["ts_event", "sequence", "instrument", "ts_recv", "action", "side", "order_id", "price", "size", "flags", "trade_date"]


@query("feature_set_light", "instrument sequence session_delta hour", "ofi_fast price_norm vwap_mid")
def feature_set_light(spark, sf):
    m = mbo(spark, sf).select(*_CORE)
    return bu.feature_set(m, mbo_order(m), "execution_aware_light_v1")


@query("feature_set_extreme", "instrument sequence flow_classification micro_aggressive_sequence_length", "ofi_slow volume_ratio micro_void_probability")
def feature_set_extreme(spark, sf):
    m = mbo(spark, sf).select(*_CORE)
    return bu.feature_set(m, mbo_order(m), "execution_aware_extreme_v1")


def _whole_set(name):
    def plan(spark, sf):
        m = mbo(spark, sf).select(*_CORE)
        return bu.feature_set(m, mbo_order(m), name)

    plan.__doc__ = f"Every column of feature set {name}."
    return plan


for _short, _name in (
    ("raw", "raw_mbo_v1"), ("basic", "basic_normalized_v1"), ("advanced", "advanced_features_v1"),
    ("medium", "execution_aware_medium_v1"), ("heavy", "execution_aware_heavy_v1"),
):
    _sql = f"WITH {MBO_SQL} SELECT ts_event, sequence, instrument, ts_recv, action, side, order_id, price, size, flags, trade_date FROM mbo"
    query(f"feature_set_{_short}", "*" if _short != "raw" else " ".join(c for c in _CORE if c != "price"), "price" if _short == "raw" else "", _sql if _short == "raw" else None)(_whole_set(_name))


@query("mbo_feature_pipeline", "instrument sequence", "net_flow_ratio_5m order_pressure mid_price_ma_5m price_return_3r")
def mbo_feature_pipeline(spark, sf):
    m = mbo(spark, sf).select(*_CORE)
    return bu.mbo_pipeline(m, mbo_order(m))


# ---------------------------------------------------------------- user functions


@query(
    "user_rolling_function",
    "instrument sequence",
    "range20",
    f"WITH {MBO_SQL} SELECT instrument, sequence, {strict('max({c})', 'price', 20)} - {strict('min({c})', 'price', 20)} AS range20 FROM mbo",
)
def user_rolling_function(spark, sf):
    m = mbo(spark, sf)
    return ub.rolling_apply(m, mbo_order(m), "price", 20, lambda x: x.max() - x.min(), "range20")


@query(
    "user_batch_function",
    "sequence code",
    "notional",
    f"WITH {MBO_SQL} SELECT sequence, action || side AS code, price * size AS notional FROM mbo",
)
def user_batch_function(spark, sf):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sequence": pdf["sequence"], "code": pdf["action"] + pdf["side"], "notional": pdf["price"] * pdf["size"]})

    return ub.process_batches(mbo(spark, sf), fn, "sequence long, code string, notional double")


@query(
    "user_group_function",
    "instrument trade_date n",
    "spread",
    f"WITH {MBO_SQL} SELECT instrument, trade_date, count(*) AS n, max(price) - min(price) AS spread FROM mbo GROUP BY 1, 2",
)
def user_group_function(spark, sf):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"instrument": [pdf["instrument"].iloc[0]], "trade_date": [pdf["trade_date"].iloc[0]], "n": [len(pdf)], "spread": [pdf["price"].max() - pdf["price"].min()]}
        )

    return ub.process_groups(mbo(spark, sf), ["instrument", "trade_date"], fn, "instrument string, trade_date date, n long, spread double")


@query(
    "training_shards",
    "events volume",
    "",
    f"WITH {MBO_SQL} SELECT count(*) AS events, CAST(sum(size) AS BIGINT) AS volume FROM mbo",
)
def training_shards(spark, sf):
    path = scratch_path(spark, "shards")
    ub.training_shards(mbo(spark, sf), path, 4, "sequence")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("volume"))
