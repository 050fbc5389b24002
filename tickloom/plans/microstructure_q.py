"""Event-scale features and flow classification."""

from pyspark.sql import functions as F

from tickloom.operators import classification as cl
from tickloom.operators import microstructure as mi
from tickloom.operators import patterns
from tickloom.plans.binding import MBO_SQL, W, mbo, mbo_order, rows, span, strict, trailing
from tickloom.plans.registry import query

_EW = f"""q AS (SELECT *, {strict('quantile_cont({c}, 0.9)', 'size', 1000)} AS q90, ts_event - lag(ts_event) OVER ({W}) AS gap, sign(price - lag(price) OVER ({W})) AS dir,
      CAST(action = 'F' AS INTEGER) AS fl, CAST(side = 'B' AS INTEGER) AS bu FROM mbo), g AS (SELECT *, CAST(coalesce(size > q90, false) AS INTEGER) AS big FROM q)"""


def _ew(n: int) -> str:
    return f"""{strict('avg({c})', 'fl', n)} AS micro_aggression_ratio_{n}e, {strict('avg({c})', 'bu', n)} AS micro_buy_ratio_{n}e, {strict('sum({c})', 'size', n)} AS micro_volume_intensity_{n}e,
      {strict('stddev_samp({c})', 'price', n)} AS micro_price_volatility_{n}e, {strict('avg({c})', 'big', n)} AS micro_large_order_freq_{n}e"""


@query(
    "event_window_features",
    "instrument sequence micro_time_since_last",
    " ".join(f"micro_{k}_{n}e" for n in (10, 25, 50, 100, 200, 500) for k in ("aggression_ratio", "buy_ratio", "volume_intensity", "price_volatility", "large_order_freq"))
    + " micro_price_momentum_10e micro_tick_momentum_50e micro_tick_direction",
    f"""WITH {MBO_SQL}, {_EW} SELECT instrument, sequence, {', '.join(_ew(n) for n in mi.EVENT_WINDOWS)}, (price - lag(price, 9) OVER ({W})) / lag(price, 9) OVER ({W}) AS micro_price_momentum_10e,
      dir AS micro_tick_direction, {strict('sum({c})', 'dir', 50)} AS micro_tick_momentum_50e, gap AS micro_time_since_last FROM g""",
)
def event_window_features(spark, sf):
    m = mbo(spark, sf)
    return mi.event_windows(m, mbo_order(m))


_LEVEL = "PARTITION BY instrument, price, side ORDER BY ts_event, sequence"


def clamp_sql(src: str, delta: str) -> str:
    """Clamped running sum per level, before and after each event."""
    up, prev = span(None, 0, _LEVEL), span(None, -1, _LEVEL)
    return f"""c0 AS (SELECT *, {delta} AS dl FROM {src}), c1 AS (SELECT *, CAST(sum(dl) OVER {up} AS BIGINT) AS s FROM c0),
    c2 AS (SELECT *, s - least(min(s) OVER {up}, 0) AS lv_after, s - dl - least(coalesce(min(s) OVER {prev}, 0), 0) AS lv_before FROM c1)"""


@query(
    "queue_positions",
    "instrument sequence micro_queue_length micro_ahead_in_queue",
    "micro_queue_position_advantage",
    f"""WITH {MBO_SQL}, {clamp_sql('mbo', "CASE action WHEN 'A' THEN 1 WHEN 'C' THEN -1 ELSE 0 END")}
    SELECT instrument, sequence, lv_after AS micro_queue_length, CASE WHEN action = 'A' THEN lv_before END AS micro_ahead_in_queue,
      CASE WHEN action = 'A' THEN 1 / (lv_before + 1) END AS micro_queue_position_advantage FROM c2""",
)
def queue_positions(spark, sf):
    m = mbo(spark, sf)
    return mi.queue_position(m, mbo_order(m))


_P100 = span(-100, -1)


@query(
    "dominance_and_flips",
    "instrument sequence",
    "micro_book_dominance_flip micro_level_concentration micro_book_flip_intensity",
    f"""WITH {MBO_SQL}, s AS (SELECT *, CASE WHEN side = 'B' THEN size ELSE 0 END AS b, CASE WHEN side = 'A' THEN size ELSE 0 END AS a, row_number() OVER ({W}) AS n FROM mbo),
    d AS (SELECT *, ({strict('sum({c})', 'b', 100)} - {strict('sum({c})', 'a', 100)}) / ({strict('sum({c})', 'b', 100)} + {strict('sum({c})', 'a', 100)} + 1e-8) AS dom,
      sum(CASE WHEN side = 'B' THEN 1 ELSE 0 END) OVER {_P100} AS nb, sum(CASE WHEN side = 'A' THEN 1 ELSE 0 END) OVER {_P100} AS na, list(price) OVER {_P100} AS ps FROM s)
    SELECT instrument, sequence, coalesce(abs(dom - lag(dom) OVER ({W})), 0) AS micro_book_dominance_flip, CASE WHEN n > 100 THEN len(list_distinct(ps)) / 100 ELSE 0.5 END AS micro_level_concentration,
      CASE WHEN n > 100 THEN 1 - abs(nb - na) / (nb + na) ELSE 0 END AS micro_book_flip_intensity FROM d""",
    digits=7,
)
def dominance_and_flips(spark, sf):
    m = mbo(spark, sf)
    return mi.dominance(m, mbo_order(m))


@query(
    "liquidity_voids",
    "instrument sequence micro_liquidity_pulled_volume micro_liquidity_momentum",
    "speed_per_s micro_void_probability",
    f"""WITH {MBO_SQL}, {clamp_sql('mbo', "CASE action WHEN 'A' THEN size WHEN 'C' THEN -size ELSE 0 END")},
    v AS (SELECT *, CASE WHEN action = 'C' THEN least(size, lv_before) ELSE 0 END AS pulled, ts_event - lag(ts_event) OVER ({W}) AS gap, row_number() OVER ({W}) AS n,
      sum(CASE WHEN action = 'C' THEN 1 ELSE 0 END) OVER {_P100} AS nc, sum(CASE WHEN action = 'A' THEN 1 ELSE 0 END) OVER {_P100} AS na FROM c2)
    SELECT instrument, sequence, pulled AS micro_liquidity_pulled_volume, coalesce(pulled / nullif(gap, 0) * 1e9, 0) AS speed_per_s,
      CASE WHEN n > 100 THEN least(nc / greatest(na, 1), 1) ELSE 0 END AS micro_void_probability, CAST({strict('sum({c})', 'pulled', 100)} AS BIGINT) AS micro_liquidity_momentum FROM v""",
)
def liquidity_voids(spark, sf):
    m = mbo(spark, sf)
    return mi.liquidity_void(m, mbo_order(m)).withColumn("speed_per_s", F.col("micro_void_creation_speed") * 1e9)


_DAY = 86_400_000_000_000


@query(
    "spoof_scores",
    "instrument sequence",
    "micro_spoof_probability micro_fake_liquidity_ratio micro_manipulation_score",
    f"""WITH {MBO_SQL}, q AS (SELECT *, {strict('quantile_cont({c}, 0.9)', 'size', 1000)} AS q90, row_number() OVER ({W}) AS n,
      sum(CASE WHEN action = 'C' THEN size ELSE 0 END) OVER {_P100} AS gone, sum(size) OVER {_P100} AS total,
      count(*) FILTER (action = 'A') OVER (PARTITION BY instrument, order_id ORDER BY ts_event, sequence ROWS UNBOUNDED PRECEDING) AS life FROM mbo),
    l AS (SELECT *, first_value(ts_event) OVER lf AS t0, first_value(size) OVER lf AS s0, count(*) FILTER (action = 'M') OVER lf AS mods, coalesce(sum(size) FILTER (action = 'F') OVER lf, 0) AS filled FROM q
      WINDOW lf AS (PARTITION BY instrument, order_id, life ORDER BY ts_event, sequence ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT *, CASE WHEN n > 100 THEN gone / greatest(total, 1) ELSE 0 END AS fake, CASE WHEN action = 'C' AND life > 0 THEN
      CASE WHEN s0 > q90 AND ts_event - t0 < {9 * _DAY} AND filled / s0 < 0.1 THEN 0.4 ELSE 0 END + CASE WHEN mods > 2 THEN 0.3 ELSE 0 END
      + CASE WHEN ts_event > t0 AND mods / (ts_event - t0) > 1e-15 THEN 0.3 ELSE 0 END ELSE 0 END AS sc FROM l)
    SELECT instrument, sequence, least(sc, 1) AS micro_spoof_probability, fake AS micro_fake_liquidity_ratio, 0.4 * least(sc, 1) + 0.3 * fake + 0.3 * sc AS micro_manipulation_score FROM x""",
    digits=10,
)
def spoof_scores(spark, sf):
    m = mbo(spark, sf)
    return mi.spoofing(m, mbo_order(m), fast_ns=9 * _DAY, mod_rate=1e-15)


@query(
    "trade_runs",
    "instrument sequence micro_aggressive_sequence_length",
    "micro_sequence_momentum micro_size_escalation urgency micro_momentum_acceleration",
    f"""WITH {MBO_SQL}, f AS (SELECT *, lag(side) OVER ({W}) AS ps FROM mbo WHERE action = 'F'), r AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side THEN 1 ELSE 0 END) OVER {span(None, 0)} AS run FROM f),
    k AS (SELECT *, row_number() OVER rw AS len, CAST(size > lag(size) OVER rw AS INTEGER) AS up, ts_event - lag(ts_event) OVER rw AS gap FROM r WINDOW rw AS (PARTITION BY instrument, run ORDER BY ts_event, sequence)),
    e AS (SELECT *, avg(up) OVER w AS esc, avg(gap) OVER w AS pause FROM k WINDOW w AS (PARTITION BY instrument, run ORDER BY ts_event, sequence ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)),
    a AS (SELECT m.instrument, m.sequence, m.ts_event, coalesce(len, 0) AS len, CASE WHEN len IS NULL THEN 0 ELSE least(1, len / 10) END AS mom, coalesce(esc, 0) AS esc, CASE WHEN pause IS NULL THEN 0 ELSE least(1, 1 / (pause / 1e6 + 1)) END AS urg
      FROM mbo m LEFT JOIN e ON m.instrument = e.instrument AND m.sequence = e.sequence)
    SELECT instrument, sequence, len AS micro_aggressive_sequence_length, mom AS micro_sequence_momentum, esc AS micro_size_escalation, urg * 1e6 AS urgency, mom - lag(mom) OVER ({W}) AS micro_momentum_acceleration FROM a""",
)
def trade_runs(spark, sf):
    m = mbo(spark, sf)
    return mi.trade_runs(m, mbo_order(m)).withColumn("urgency", F.col("micro_sequence_urgency") * 1e6)


@query(
    "urgency_trend",
    "instrument sequence",
    "trend",
    f"""WITH {MBO_SQL}, f AS (SELECT *, lag(side) OVER ({W}) AS ps FROM mbo WHERE action = 'F'), r AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side THEN 1 ELSE 0 END) OVER {span(None, 0)} AS run FROM f),
    k AS (SELECT *, ts_event - lag(ts_event) OVER (PARTITION BY instrument, run ORDER BY ts_event, sequence) AS gap FROM r),
    e AS (SELECT *, avg(gap) OVER (PARTITION BY instrument, run ORDER BY ts_event, sequence ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS pause FROM k),
    a AS (SELECT m.*, CASE WHEN pause IS NULL THEN 0 ELSE least(1, 1 / (pause / 1e6 + 1)) END AS urg, row_number() OVER (PARTITION BY m.instrument ORDER BY m.ts_event, m.sequence) AS i FROM mbo m LEFT JOIN e ON m.instrument = e.instrument AND m.sequence = e.sequence)
    SELECT instrument, sequence, CASE WHEN i >= 10 THEN regr_slope(urg * 1e9, i) OVER {rows(10)} END AS trend FROM a""",
    digits=2,
)
def urgency_trend(spark, sf):
    m = mbo(spark, sf)
    return mi.trade_runs(m, mbo_order(m)).withColumn("trend", F.col("micro_urgency_trend") * 1e9)


def _count(us: int) -> str:
    return f"count(*) OVER {trailing(us * 1000)} / {us}.0::DOUBLE * 1e6"


_WIN = {"10m": 600_000_000, "1h": 3_600_000_000, "6h": 21_600_000_000}


@query(
    "flow_intensity",
    "instrument sequence",
    "i10m i1h i6h micro_flow_burst_ratio change",
    f"""WITH {MBO_SQL}, c AS (SELECT *, {_count(_WIN['10m'])} AS i10m, {_count(_WIN['1h'])} AS i1h, {_count(_WIN['6h'])} AS i6h, row_number() OVER ({W}) AS n FROM mbo)
    SELECT instrument, sequence, i10m, i1h, i6h, CASE WHEN n > 100 THEN least(10, i1h / avg(i1h) OVER {_P100}) ELSE 0 END AS micro_flow_burst_ratio, i1h - lag(i1h) OVER ({W}) AS change FROM c""",
    digits=9,
)
def flow_intensity(spark, sf):
    m = mbo(spark, sf)
    d = mi.flow_intensity(m, mbo_order(m), _WIN, main="1h")
    per = {f"i{k}": F.col(f"micro_flow_intensity_{k}") * 1e6 for k in _WIN}
    return d.withColumns({**per, "change": F.col("micro_flow_density_change") * 1e6})


@query(
    "flow_intensity_microseconds",
    "instrument sequence",
    "micro_flow_intensity_100us micro_flow_intensity_1ms micro_flow_intensity_10ms micro_adaptive_window",
    f"""WITH {MBO_SQL}, c AS (SELECT *, count(*) OVER {trailing(100_000)} / 100 AS a, count(*) OVER {trailing(1_000_000)} / 1000 AS b, count(*) OVER {trailing(10_000_000)} / 10000 AS c FROM mbo)
    SELECT instrument, sequence, a AS micro_flow_intensity_100us, b AS micro_flow_intensity_1ms, c AS micro_flow_intensity_10ms, 1 / (b + 0.001) AS micro_adaptive_window FROM c""",
)
def flow_intensity_microseconds(spark, sf):
    m = mbo(spark, sf)
    return mi.flow_intensity(m, mbo_order(m))


@query(
    "latency_and_alpha",
    "instrument sequence",
    "receive_latency_ms total_latency_ms alpha_remaining competitive_window_ms",
    f"""WITH {MBO_SQL}, l AS (SELECT *, (ts_recv - ts_event) / 1e6 AS r FROM mbo) SELECT instrument, sequence, r AS receive_latency_ms, r + 2.5 AS total_latency_ms,
      100 * exp(-(r + 2.5) / 20) AS alpha_remaining, greatest(0, 2.55 - (r + 2.5)) AS competitive_window_ms FROM l""",
)
def latency_and_alpha(spark, sf):
    return mi.latency_features(mbo(spark, sf), 2.5, 20.0, 2.55)


# ---------------------------------------------------------------- classification

N = 200
_TS = "fm AS (SELECT * REPLACE (ts_event + sequence % 8 * 125 AS ts_event) FROM mbo)"
_SIDE = "PARTITION BY instrument, side ORDER BY ts_event, sequence"


def flow_input(spark, sf):
    return mbo(spark, sf).withColumn("ts_event", F.col("ts_event") + F.col("sequence") % 8 * 125)


FLOW_SQL = f"""{_TS}, f0 AS (SELECT *, ts_event - lag(ts_event) OVER ({W}) AS gap, (price - lag(price) OVER ({W})) / lag(price) OVER ({W}) AS ret, lead(price, 5) OVER ({W}) AS p5, lag(size) OVER ({W}) AS ps,
      CAST(action = 'F' AS INTEGER) AS fl, CAST(side = 'B' AS INTEGER) AS bu, CASE WHEN side = 'B' THEN 1 ELSE -1 END AS dir, row_number() OVER ({W}) AS n,
      CAST(size > lag(size) OVER ({_SIDE}) AS INTEGER) AS up, ts_event - lag(ts_event) OVER ({_SIDE}) AS sgap FROM fm),
    f1 AS (SELECT *, gap - lag(gap) OVER ({W}) AS gap2, coalesce(lead(ret, 5) OVER ({W}), 0) AS fut, row_number() OVER ({_SIDE}) AS sn, list(size) OVER {rows(N, _SIDE)} AS sl, list(size) OVER {rows(N)} AS al,
      list(gap) OVER {rows(N)} AS gl, list(gap) OVER {rows(N - 1)} AS gl1 FROM f0),
    f2 AS (SELECT *, CAST(gap2 % 1000 = 0 AS INTEGER) AS rnd, CASE WHEN sn >= {N} THEN quantile_cont(size, 0.8) OVER {rows(N, _SIDE)} END AS q80, {strict('quantile_cont({c}, 0.95)', 'size', N)} AS q95,
      {strict('quantile_cont({c}, 0.1)', 'gap', N)} AS q10, {strict('quantile_cont({c}, 0.25)', 'gap', N - 1)} AS q25, {strict('avg({c})', 'size', N)} AS mu, {strict('stddev_samp({c})', 'size', N)} AS sd FROM f1),
    fx AS (SELECT *, CASE WHEN q80 IS NOT NULL THEN len([x for x in sl if x > q80]) / {N} END AS flow_aggressive_ratio, 1 / (1 + sd / (mu + 1e-8)) AS flow_size_clustering,
      CASE WHEN sn >= {N} THEN avg(fl) OVER {rows(N, _SIDE)} END AS flow_fill_ratio, CASE WHEN n >= {N} THEN (len([x for x in al if x < size]) + (len([x for x in al if x = size]) + 1) / 2) / {N} END AS flow_size_percentile,
      CASE WHEN count(gap) OVER {rows(N)} >= {N} THEN avg(rnd) OVER {rows(N - 1)} END AS flow_timing_precision, CASE WHEN q25 IS NOT NULL THEN len([x for x in gl1 if x < q25]) / {N - 1} END AS flow_submission_clustering,
      CASE WHEN q10 IS NOT NULL THEN len([x for x in gl if x < q10]) / {N} END AS flow_latency_advantage, CASE WHEN n > {N} THEN coalesce(abs(corr(dir, fut) OVER {span(-N, -1)}), 0.5) ELSE 0.5 END AS flow_price_impact_accuracy,
      coalesce({strict('avg({c})', 'fl', N)}, 0.5) AS flow_conditional_fill_rate, CASE WHEN sn >= {N} THEN sum(up) OVER {rows(N - 1, _SIDE)} / {N} END AS flow_continuation_prob,
      coalesce(2 * abs({strict('avg({c})', 'bu', N)} - 0.5), 0.5) AS flow_directional_persistence, CASE WHEN n >= {N} THEN abs(corr(size, ps) OVER {rows(N - 1)}) END AS flow_size_persistence,
      size / mu AS flow_aggressiveness_score, CAST(coalesce(size > q95, false) AS INTEGER) AS flow_large_order_flag, sd / mu AS flow_size_volatility, size - lag(size, 10) OVER ({W}) AS flow_size_momentum,
      {strict('sum({c})', 'size', N)} / {N} AS flow_liquidity_consumption, {strict('avg({c})', 'sgap', N)} / 1e9 AS speed, CASE WHEN count(gap) OVER {rows(N)} >= {N} THEN stddev_samp(gap2) OVER {rows(N - 1)} END AS g2s,
      avg(gap2) OVER {rows(N - 1)} AS g2m, CASE WHEN sn >= {N} AND p5 IS NOT NULL THEN corr(size, p5) OVER {rows(N, _SIDE)} END AS flow_price_correlation FROM f2)"""


@query(
    "flow_execution_patterns",
    "instrument sequence flow_large_order_flag flow_size_momentum",
    "flow_aggressive_ratio flow_size_clustering flow_fill_ratio flow_size_percentile flow_aggressiveness_score flow_size_volatility",
    f"WITH {MBO_SQL}, {FLOW_SQL} SELECT * FROM fx",
)
def flow_execution_patterns(spark, sf):
    m = flow_input(spark, sf)
    return cl.flow_features(m, mbo_order(m), N)


@query(
    "flow_timing_and_information",
    "instrument sequence",
    "flow_timing_precision flow_submission_clustering flow_latency_advantage speed flow_price_impact_accuracy flow_alpha_potential flow_price_correlation",
    f"WITH {MBO_SQL}, {FLOW_SQL} SELECT *, pow(flow_price_impact_accuracy, 2) AS flow_alpha_potential FROM fx",
)
def flow_timing_and_information(spark, sf):
    m = flow_input(spark, sf)
    return cl.flow_features(m, mbo_order(m), N).withColumn("speed", F.col("flow_execution_speed") / 1e9)


@query(
    "flow_persistence",
    "instrument sequence",
    "flow_liquidity_consumption flow_conditional_fill_rate flow_continuation_prob flow_directional_persistence flow_size_persistence",
    f"WITH {MBO_SQL}, {FLOW_SQL} SELECT * FROM fx",
)
def flow_persistence(spark, sf):
    m = flow_input(spark, sf)
    return cl.flow_features(m, mbo_order(m), N)


@query(
    "flow_order_level_rates",
    "instrument sequence",
    "flow_modification_rate flow_iceberg_probability",
    f"""WITH {MBO_SQL}, {_TS}, x AS (SELECT *, CAST(action IN ('A', 'M') AS INTEGER) AS am, list(size) OVER p AS sl FROM fm WINDOW p AS (PARTITION BY instrument, price, side ORDER BY ts_event, sequence ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT instrument, sequence, CASE WHEN count(*) OVER o >= 4 THEN avg(am) OVER o END AS flow_modification_rate,
      CASE WHEN len(sl) >= 20 THEN least(1, list_max([len([y for y in sl if y = z]) for z in sl]) / 20 * 5) END AS flow_iceberg_probability FROM x
    WINDOW o AS (PARTITION BY instrument, order_id ORDER BY ts_event, sequence ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def flow_order_level_rates(spark, sf):
    m = flow_input(spark, sf)
    o = mbo_order(m)
    return cl.iceberg_probability(cl.modification_rate(m, o, 4), o, 20)


def _norm(c: str, w: float) -> str:
    return f"{w} * coalesce(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-8), 0.5)"


_ROW = ", ".join(f"coalesce({c}, 0.5)" for c in cl.FLOW_COLUMNS)
TOXIC_SQL = f"""fa AS (SELECT *, flow_price_impact_accuracy AS flow_adverse_selection_prob, pow(flow_price_impact_accuracy, 2) AS flow_alpha_potential FROM fx),
    ft AS (SELECT *, least(greatest({' + '.join(_norm(c, w) for c, w in cl.TOXICITY_WEIGHTS.items())}, 0), 1) AS sc, [{_ROW}]::DOUBLE[] AS r FROM fa),
    tox AS (SELECT *, CASE WHEN sc >= 0.7 THEN 'toxic' WHEN sc <= 0.3 THEN 'benign' ELSE 'neutral' END AS flow_classification,
      least(greatest(1 - list_stddev_samp(r) / (list_avg(r) + 1e-8), 0), 1) AS conf FROM ft)"""


@query(
    "toxicity_classes",
    "instrument sequence flow_classification",
    "flow_toxicity_score flow_classification_confidence",
    f"WITH {MBO_SQL}, {FLOW_SQL}, {TOXIC_SQL} SELECT instrument, sequence, flow_classification, sc AS flow_toxicity_score, conf AS flow_classification_confidence FROM tox",
)
def toxicity_classes(spark, sf):
    m = flow_input(spark, sf)
    return cl.classify(cl.flow_features(m, mbo_order(m), N))


@query(
    "flow_class_report",
    "flow_classification events volume",
    "mean_toxicity adverse_selection_risk persistence size_aggressiveness information_content",
    f"""WITH {MBO_SQL}, {FLOW_SQL}, {TOXIC_SQL} SELECT flow_classification, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume, avg(sc) AS mean_toxicity,
      avg(flow_adverse_selection_prob) AS adverse_selection_risk, avg(flow_directional_persistence) AS persistence, avg(flow_aggressiveness_score) AS size_aggressiveness,
      avg((flow_price_impact_accuracy + flow_alpha_potential) / 2) AS information_content FROM tox GROUP BY 1""",
)
def flow_class_report(spark, sf):
    m = flow_input(spark, sf)
    return patterns.flow_report(cl.classify(cl.flow_features(m, mbo_order(m), N)))
