"""Order-flow feature bundles."""

from tickloom.operators import order_flow as of
from tickloom.plans.binding import MBO_SQL, W, mbo, mbo_order, rows, strict
from tickloom.plans.registry import query
from tickloom.plans.tick_features_q import ema_rec

BASE = f"""b AS (SELECT *, size AS volume, price - lag(price) OVER ({W}) AS chg, (price - lag(price) OVER ({W})) / lag(price) OVER ({W}) AS ret,
      abs((price - lag(price) OVER ({W})) / lag(price) OVER ({W})) AS aret, ts_event - lag(ts_event) OVER ({W}) AS gap, row_number() OVER ({W}) AS n,
      CASE WHEN side = 'B' THEN size ELSE 0 END AS bv, CASE WHEN side = 'A' THEN size ELSE 0 END AS sv,
      CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END / (CASE WHEN side IN ('A', 'B') THEN size ELSE 0 END + 1e-8) AS vi FROM mbo)"""


def pct(c: str, k: int = 1) -> str:
    lag = f"lag({c}, {k}) OVER ({W})"
    return f"({c} - {lag}) / nullif({lag}, 0)"


def register(name: str, bundle: str, exact: str, floats: str, sql: str, digits: int = 4):
    @query(name, "instrument sequence " + exact, floats, f"WITH {MBO_SQL}, {BASE} {sql}", digits)
    def plan(spark, sf):
        m = mbo(spark, sf)
        return of.order_flow(m, mbo_order(m), [bundle])

    return plan


def skew(c: str, n: int) -> str:
    w = rows(n)
    m = f"avg({c}) OVER {w}"
    return f"""CASE WHEN count({c}) OVER {w} >= {n} THEN (avg(pow({c}::DOUBLE, 3)) OVER {w} - 3 * {m} * avg(pow({c}::DOUBLE, 2)) OVER {w} + 2 * pow({m}, 3))
      / pow(var_pop({c}) OVER {w}, 1.5) END"""


register(
    "volume_analysis",
    "volume",
    "",
    "volume_ma volume_std volume_ratio buy_volume_ma sell_volume_ma volume_profile_skew volume_profile_kurtosis volume_momentum_5r volume_acceleration_5r volume_volatility_30r volume_volatility_120r",
    f""", v AS (SELECT *, {pct('volume', 5)} AS m5 FROM b) SELECT instrument, sequence, {strict('avg({c})', 'volume', 20)} AS volume_ma, {strict('stddev_samp({c})', 'volume', 20)} AS volume_std,
      volume / ({strict('avg({c})', 'volume', 20)}) AS volume_ratio, {strict('avg({c})', 'bv', 20)} AS buy_volume_ma, {strict('avg({c})', 'sv', 20)} AS sell_volume_ma,
      {skew('volume', 100)} AS volume_profile_skew, {strict('kurtosis_pop({c})', 'volume', 100)} AS volume_profile_kurtosis, m5 AS volume_momentum_5r, {pct('m5')} AS volume_acceleration_5r,
      {strict('stddev_samp({c})', 'volume', 30)} AS volume_volatility_30r, {strict('stddev_samp({c})', 'volume', 120)} AS volume_volatility_120r FROM v""",
)

register(
    "imbalance_analysis",
    "imbalance",
    "order_flow_imbalance",
    "volume_imbalance_ma volume_imbalance_std volume_imbalance_momentum_5r price_imbalance price_imbalance_ma price_volume_imbalance order_flow_imbalance_ma",
    f""", v AS (SELECT *, CASE side WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS ofi FROM b)
    SELECT instrument, sequence, ofi AS order_flow_imbalance, {strict('avg({c})', 'vi', 20)} AS volume_imbalance_ma, {strict('stddev_samp({c})', 'vi', 20)} AS volume_imbalance_std,
      {pct('vi', 5)} AS volume_imbalance_momentum_5r, ret AS price_imbalance, {strict('avg({c})', 'ret', 20)} AS price_imbalance_ma, ret * vi AS price_volume_imbalance,
      {strict('avg({c})', 'ofi', 20)} AS order_flow_imbalance_ma FROM v""",
)

register(
    "pattern_detection",
    "patterns",
    "iceberg_detection absorption_detection order_block_detection support_resistance_detection iceberg_persistence order_block_volume support_resistance_volume",
    "iceberg_confidence absorption_intensity absorption_confidence order_block_confidence",
    f""", r AS (SELECT instrument, min(price) lo, max(price) hi FROM mbo GROUP BY 1),
    l AS (SELECT b.*, CAST(sum(size) OVER (PARTITION BY b.instrument, round(price, 2)) AS BIGINT) AS ob,
      CAST(sum(size) OVER (PARTITION BY b.instrument, least(greatest(ceil((price - lo) / ((hi - lo) / 50.0)) - 1, 0), 49)) AS BIGINT) AS sr FROM b JOIN r ON b.instrument = r.instrument),
    q AS (SELECT *, {strict('quantile_cont({c}, 0.95)', 'size', 100)} AS q95, volume / ({strict('avg({c})', 'volume', 20)}) AS vr, {strict('quantile_cont({c}, 0.9)', 'ob', 50)} AS b90,
      {strict('max({c})', 'ob', 50)} AS bmax, {strict('quantile_cont({c}, 0.95)', 'sr', 100)} AS s95 FROM l),
    d AS (SELECT *, CAST(coalesce(size > q95, false) AS INTEGER) AS iceberg_detection, CAST(coalesce(vr > 2 AND aret < 0.001, false) AS INTEGER) AS absorption_detection,
      vr * (1 - aret) AS absorption_intensity, CAST(coalesce(ob > b90, false) AS INTEGER) AS order_block_detection, CAST(coalesce(sr > s95, false) AS INTEGER) AS support_resistance_detection FROM q)
    SELECT *, ob AS order_block_volume, sr AS support_resistance_volume, CAST({strict('sum({c})', 'iceberg_detection', 10)} AS BIGINT) AS iceberg_persistence,
      iceberg_detection * size / q95 AS iceberg_confidence, absorption_detection * absorption_intensity AS absorption_confidence, order_block_detection * ob / bmax AS order_block_confidence FROM d""",
)

register(
    "microstructure_estimates",
    "microstructure",
    "order_book_depth",
    "estimated_spread spread_volatility depth_imbalance market_impact liquidity_ma order_flow_toxicity",
    f""", s AS (SELECT *, {strict('avg({c})', 'aret', 20)} AS es, {strict('stddev_samp({c})', 'aret', 20)} AS sv20, {strict('sum({c})', 'volume', 10)} AS depth,
      {strict('max({c})', 'volume', 100)} AS vmax, CASE WHEN lag(side) OVER ({W}) IS NULL OR lag(side) OVER ({W}) <> side THEN 1 ELSE 0 END AS turn FROM b),
    l AS (SELECT *, volume / (es + 1e-8) AS lr FROM s)
    SELECT instrument, sequence, CAST(depth AS BIGINT) AS order_book_depth, es AS estimated_spread, sv20 AS spread_volatility, {pct('depth')} AS depth_imbalance,
      aret / (volume / vmax + 1e-8) AS market_impact, {strict('avg({c})', 'lr', 20)} AS liquidity_ma, {strict('avg({c})', 'turn', 50)} AS order_flow_toxicity FROM l""",
)

register(
    "var_cvar",
    "risk",
    "",
    "var_95 var_99 cvar_95 cvar_99 volatility_20 volatility_100 volatility_of_volatility_50 returns_skew returns_kurtosis",
    f""", v AS (SELECT *, {strict('quantile_cont({c}, 0.050000000000000044)', 'ret', 100)} AS v95, {strict('quantile_cont({c}, 0.010000000000000009)', 'ret', 100)} AS v99,
      list(ret) OVER {rows(100)} AS rets, {strict('stddev_samp({c})', 'ret', 50)} AS vol50 FROM b)
    SELECT instrument, sequence, v95 AS var_95, v99 AS var_99, CASE WHEN v95 IS NOT NULL THEN list_avg([x for x in rets if x <= v95]) END AS cvar_95,
      CASE WHEN v99 IS NOT NULL THEN list_avg([x for x in rets if x <= v99]) END AS cvar_99, {strict('stddev_samp({c})', 'ret', 20)} AS volatility_20, {strict('stddev_samp({c})', 'ret', 100)} AS volatility_100,
      {strict('stddev_samp({c})', 'vol50', 50)} AS volatility_of_volatility_50, {skew('ret', 100)} AS returns_skew, {strict('kurtosis_pop({c})', 'ret', 100)} AS returns_kurtosis FROM v""",
)

register(
    "drawdown",
    "risk",
    "",
    "drawdown max_drawdown",
    f""", p AS (SELECT *, {strict('max({c})', 'price', 100)} AS pk FROM b), d AS (SELECT *, (price - pk) / pk AS dd FROM p)
    SELECT instrument, sequence, dd AS drawdown, {strict('min({c})', 'dd', 100)} AS max_drawdown FROM d""",
)


def ac(c: str, n: int, k: int) -> str:
    return f"CASE WHEN count({c}) OVER {rows(n)} >= {n} THEN corr({c}, lag{k}) OVER {rows(n - k)} END"


_BINS = " + ".join(
    f"CASE WHEN len([x for x in px if {b} = least(floor((x - lo) / nullif(hi - lo, 0) * 10), 9)]) > 0 THEN -len([x for x in px if {b} = least(floor((x - lo) / nullif(hi - lo, 0) * 10), 9)]) / 20 * ln(len([x for x in px if {b} = least(floor((x - lo) / nullif(hi - lo, 0) * 10), 9)]) / 20) ELSE 0 END"
    for b in range(10)
)

register(
    "rolling_corr_autocorr",
    "statistics",
    "",
    "price_volume_corr_20 price_volume_corr_100 price_autocorr_lag_1 price_autocorr_lag_5 price_autocorr_lag_10 price_entropy",
    f""", l AS (SELECT *, lag(price, 1) OVER ({W}) AS lag1, lag(price, 5) OVER ({W}) AS lag5, lag(price, 10) OVER ({W}) AS lag10, list(price) OVER {rows(20)} AS px,
      min(price) OVER {rows(20)} AS lo, max(price) OVER {rows(20)} AS hi FROM b)
    SELECT instrument, sequence, CASE WHEN n >= 20 THEN corr(price, volume) OVER {rows(20)} END AS price_volume_corr_20, CASE WHEN n >= 100 THEN corr(price, volume) OVER {rows(100)} END AS price_volume_corr_100,
      {ac('price', 50, 1)} AS price_autocorr_lag_1, {ac('price', 50, 5)} AS price_autocorr_lag_5, {ac('price', 50, 10)} AS price_autocorr_lag_10, CASE WHEN n >= 20 THEN {_BINS} END AS price_entropy FROM l""",
)

register(
    "rolling_zscores",
    "statistics",
    "",
    "price_ma_5r price_std_5r price_zscore_15r vol_ma_30r vol_std_120r vol_zscore_60r price_zscore_120r",
    f"""SELECT instrument, sequence, {strict('avg({c})', 'price', 5)} AS price_ma_5r, {strict('stddev_samp({c})', 'price', 5)} AS price_std_5r,
      (price - ({strict('avg({c})', 'price', 15)})) / nullif({strict('stddev_samp({c})', 'price', 15)}, 0) AS price_zscore_15r, {strict('avg({c})', 'volume', 30)} AS vol_ma_30r,
      {strict('stddev_samp({c})', 'volume', 120)} AS vol_std_120r, (volume - ({strict('avg({c})', 'volume', 60)})) / ({strict('stddev_samp({c})', 'volume', 60)}) AS vol_zscore_60r,
      (price - ({strict('avg({c})', 'price', 120)})) / ({strict('stddev_samp({c})', 'price', 120)}) AS price_zscore_120r FROM b""",
)

register(
    "temporal_features",
    "temporal",
    "hour_of_day minute_of_hour day_of_week time_since_last_event",
    "hour_sin hour_cos minute_sin minute_cos day_sin day_cos",
    f"""SELECT instrument, sequence, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(minute(ts) AS INTEGER) AS minute_of_hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, gap AS time_since_last_event,
      sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * minute(ts) / 60) AS minute_sin, cos(2 * pi() * minute(ts) / 60) AS minute_cos,
      sin(2 * pi() * (isodow(ts) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS day_cos FROM b""",
)

register(
    "greeks_style",
    "greeks",
    "",
    "delta_ma gamma gamma_ma theta vega",
    f""", g AS (SELECT *, {pct('ret')} AS gamma, {strict('stddev_samp({c})', 'ret', 20)} AS vol FROM b)
    SELECT instrument, sequence, {strict('avg({c})', 'ret', 20)} AS delta_ma, gamma, {strict('avg({c})', 'gamma', 20)} AS gamma_ma, gap / ({strict('avg({c})', 'gap', 100)} + 1e-8) AS theta, {pct('vol')} AS vega FROM g""",
)

register(
    "roll_spread_amihud",
    "liquidity",
    "",
    "amihud_ma roll_spread bid_ask_bounce",
    f""", l AS (SELECT *, aret / (volume + 1e-8) AS am, lag(ret) OVER ({W}) AS pr FROM b),
    c AS (SELECT *, CASE WHEN count(ret * pr) OVER {rows(20)} >= 20 THEN covar_samp(ret, pr) OVER {rows(20)} END AS cov, CAST(coalesce(ret * pr < 0, false) AS INTEGER) AS back FROM l)
    SELECT instrument, sequence, {strict('avg({c})', 'am', 20)} AS amihud_ma, CASE WHEN cov <= 0 THEN 2 * sqrt(-cov) END AS roll_spread, {strict('avg({c})', 'back', 20)} AS bid_ask_bounce FROM c""",
    digits=6,
)

register(
    "rsi",
    "momentum",
    "",
    "rsi_14 rsi_20 rsi_50",
    "SELECT instrument, sequence, "
    + ", ".join(
        f"CASE WHEN n >= {k} THEN 100 - 100 / (1 + avg(coalesce(greatest(chg, 0), 0)) OVER {rows(k)} / (avg(coalesce(greatest(-chg, 0), 0)) OVER {rows(k)} + 1e-8)) END AS rsi_{k}"
        for k in (14, 20, 50)
    )
    + " FROM b",
)

register(
    "momentum_macd",
    "momentum",
    "",
    "price_momentum_15r price_momentum_ma_15r price_momentum_ma_120r vol_momentum_ma_5r macd macd_signal macd_histogram",
    f""", x AS (SELECT *, {pct('price', 15)} AS m15, {pct('price', 120)} AS m120, {pct('volume', 5)} AS v5 FROM b),
    src AS (SELECT instrument, sequence, n, price FROM b), {ema_rec('a', 'src', 'price', 2 / 13, True)}, {ema_rec('z', 'src', 'price', 2 / 27, True)},
    mc AS (SELECT src.instrument, src.sequence, n, a.y - z.y AS macd FROM src JOIN a USING (instrument, sequence) JOIN z USING (instrument, sequence)), {ema_rec('s', 'mc', 'macd', 0.2, True)}
    SELECT x.instrument, x.sequence, m15 AS price_momentum_15r, {strict('avg({c})', 'm15', 15, W.replace('instrument', 'x.instrument').replace('sequence', 'x.sequence'))} AS price_momentum_ma_15r,
      {strict('avg({c})', 'm120', 120, W.replace('instrument', 'x.instrument').replace('sequence', 'x.sequence'))} AS price_momentum_ma_120r,
      {strict('avg({c})', 'v5', 5, W.replace('instrument', 'x.instrument').replace('sequence', 'x.sequence'))} AS vol_momentum_ma_5r, macd, s.y AS macd_signal, macd - s.y AS macd_histogram
    FROM x JOIN mc ON x.instrument = mc.instrument AND x.sequence = mc.sequence JOIN s ON x.instrument = s.instrument AND x.sequence = s.sequence""",
    digits=6,
)

register(
    "divergence_and_interactions",
    "divergence",
    "",
    "price_volume_divergence divergence_strength momentum_divergence momentum_divergence_strength volume_imbalance_interaction price_volume_interaction",
    f""", x AS (SELECT *, {pct('price', 5)} AS p5, {pct('price', 20)} AS p20, {pct('volume', 5)} AS v5 FROM b)
    SELECT instrument, sequence, sign(p5) * sign(v5) AS price_volume_divergence, abs(p5) * abs(v5) AS divergence_strength, sign(p5) * sign(p20) AS momentum_divergence,
      abs(p5 - p20) AS momentum_divergence_strength, volume * vi AS volume_imbalance_interaction, ret * volume AS price_volume_interaction FROM x""",
    digits=10,
)

register(
    "multi_timeframe",
    "timeframes",
    "",
    "mtf_momentum_1r mtf_momentum_60r mtf_momentum_1440r mtf_volatility_15r mtf_volatility_240r mtf_volatility_1440r momentum_alignment",
    f""", x AS (SELECT *, {pct('price', 1)} AS p1, {pct('price', 30)} AS p30, {pct('price', 240)} AS p240 FROM b)
    SELECT instrument, sequence, p1 AS mtf_momentum_1r, {pct('price', 60)} AS mtf_momentum_60r, {pct('price', 1440)} AS mtf_momentum_1440r, {strict('stddev_samp({c})', 'ret', 15)} AS mtf_volatility_15r,
      {strict('stddev_samp({c})', 'ret', 240)} AS mtf_volatility_240r, {strict('stddev_samp({c})', 'ret', 1440)} AS mtf_volatility_1440r, (sign(p1) + sign(p30) + sign(p240)) / 3 AS momentum_alignment FROM x""",
)

register(
    "flow_intelligence",
    "intelligence",
    "smart_money_detection order_clustering",
    "market_efficiency",
    f""", x AS (SELECT *, {strict('quantile_cont({c}, 0.9)', 'volume', 100)} AS v90, {strict('quantile_cont({c}, 0.1)', 'aret', 100)} AS r10, list(volume) OVER {rows(10)} AS l,
      {strict('avg({c})', 'volume', 10)} + {strict('stddev_samp({c})', 'volume', 10)} AS cut, lag(ret) OVER ({W}) AS lag1 FROM b)
    SELECT instrument, sequence, CAST(coalesce(volume > v90 AND aret < r10, false) AS INTEGER) AS smart_money_detection,
      CASE WHEN cut IS NOT NULL THEN CAST(len([z for z in l if z > cut]) AS INTEGER) END AS order_clustering, 1 - abs({ac('ret', 20, 1)}) AS market_efficiency FROM x""",
)

REGIME_SQL = f"""v AS (SELECT *, {strict('stddev_samp({c})', 'ret', 20)} AS vol FROM b),
    e AS (SELECT instrument, list_distinct(quantile_cont(vol, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS ev, list_distinct(quantile_cont(size, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS es FROM v GROUP BY 1),
    g AS (SELECT v.*, CASE WHEN vol IS NOT NULL THEN CAST(greatest(len([x for x in ev if x < vol]) - 1, 0) AS INTEGER) END AS vr,
      CAST(greatest(len([x for x in es if x < size]) - 1, 0) AS INTEGER) AS sr FROM v JOIN e USING (instrument)),
    st AS (SELECT *, vr + sr AS ms FROM g)"""


@query(
    "market_regimes",
    "instrument sequence volatility_regime volume_regime market_state regime_change volume_regime_change state_persistence regime_interaction",
    "regime_momentum_30r regime_momentum_120r",
    f"""WITH {MBO_SQL}, {BASE}, {REGIME_SQL} SELECT instrument, sequence, vr AS volatility_regime, sr AS volume_regime, ms AS market_state, abs(vr - lag(vr) OVER ({W})) AS regime_change,
      abs(sr - lag(sr) OVER ({W})) AS volume_regime_change, CASE WHEN count(ms) OVER {rows(50)} >= 50 THEN CAST(50 - len(list_distinct(list(ms) OVER {rows(50)})) AS INTEGER) END AS state_persistence,
      vr * sr AS regime_interaction, {strict('avg({c})', 'ms', 30)} AS regime_momentum_30r, {strict('avg({c})', 'ms', 120)} AS regime_momentum_120r FROM st""",
)
def market_regimes(spark, sf):
    m = mbo(spark, sf)
    return of.regimes(m, mbo_order(m))
