"""Statistics, quality and pattern queries."""

from pyspark.sql import functions as F

from tickloom.operators import patterns, quality
from tickloom.plans.binding import MBO_SQL, mbo, mbo_order, table
from tickloom.plans.registry import query

NUMS = ["price", "size", "flags", "value", "sequence"]


@query(
    "mbo_statistics",
    "instrument events first_ts last_ts min_size max_size volume",
    "min_price max_price mean_size std_size",
    f"""WITH {MBO_SQL} SELECT instrument, count(*) AS events, min(ts_event) AS first_ts, max(ts_event) AS last_ts,
      min(price) AS min_price, max(price) AS max_price, avg(size) AS mean_size, stddev_samp(size) AS std_size,
      min(size) AS min_size, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS volume FROM mbo GROUP BY 1""",
)
def mbo_statistics(spark, sf):
    return quality.event_statistics(mbo(spark, sf))


@query(
    "action_side_distribution",
    "action side events volume",
    "share",
    f"""WITH {MBO_SQL} SELECT action, side, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume,
      count(*) / sum(count(*)) OVER () AS share FROM mbo GROUP BY 1, 2""",
)
def action_side_distribution(spark, sf):
    return quality.distribution(mbo(spark, sf), "action", "side")


@query(
    "flag_distribution",
    "flags events volume",
    "share",
    f"""WITH {MBO_SQL} SELECT flags, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume,
      count(*) / sum(count(*)) OVER () AS share FROM mbo GROUP BY 1""",
)
def flag_distribution(spark, sf):
    return quality.distribution(mbo(spark, sf), "flags")


@query(
    "dataset_summary",
    "records instruments first_ts last_ts actions sides volume last_flagged sequence_gaps",
    "seconds mean_price",
    f"""WITH {MBO_SQL}, g AS (SELECT *, lag(sequence) OVER (PARTITION BY instrument ORDER BY ts_event, sequence) AS p FROM mbo)
    SELECT count(*) AS records, count(DISTINCT instrument) AS instruments, min(ts_event) AS first_ts,
      max(ts_event) AS last_ts, (max(ts_event) - min(ts_event)) / 1e9 AS seconds,
      string_agg(DISTINCT action, ',' ORDER BY action) AS actions, string_agg(DISTINCT side, ',' ORDER BY side) AS sides,
      avg(price) AS mean_price, CAST(sum(size) AS BIGINT) AS volume,
      count(*) FILTER (flags & 128 <> 0) AS last_flagged, count(*) FILTER (p + 1 <> sequence) AS sequence_gaps FROM g""",
)
def dataset_summary(spark, sf):
    m = mbo(spark, sf)
    return quality.dataset_summary(m, mbo_order(m))


@query(
    "sequence_gaps",
    "instrument sequence prev_sequence gap",
    "",
    f"""WITH {MBO_SQL}, g AS (SELECT *, lag(sequence) OVER (PARTITION BY instrument ORDER BY ts_event, sequence) AS prev_sequence FROM mbo)
    SELECT instrument, sequence, prev_sequence, sequence - prev_sequence - 1 AS gap FROM g WHERE prev_sequence + 1 <> sequence""",
)
def sequence_gaps(spark, sf):
    m = mbo(spark, sf)
    return quality.sequence_gaps(m, mbo_order(m))


def _checks(pairs):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{k}' AS key, CAST({e} AS DOUBLE) AS value FROM mbo" for c, k, e in pairs)


_QR = (
    [("rows", "total", "count(*)")]
    + [("nulls", c, f"count(*) FILTER ({c} IS NULL)") for c in ("ts_event", "price", "size", "side", "action", "order_id")]
    + [
        ("clock", "valid", "count(*) FILTER (ts_event > 0)"),
        ("clock", "invalid", "count(*) FILTER (NOT coalesce(ts_event > 0, false))"),
        ("price", "valid", "count(*) FILTER (price > 0)"),
        ("price", "invalid", "count(*) FILTER (NOT coalesce(price > 0, false))"),
        ("action", "invalid", "count(*) FILTER (action NOT IN ('A','M','C','R','T','F','N'))"),
        ("side", "invalid", "count(*) FILTER (side NOT IN ('B','A','N'))"),
    ]
    + [("action", a, f"count(*) FILTER (action = '{a}')") for a in "AMCRTFN"]
    + [("side", s, f"count(*) FILTER (side = '{s}')") for s in "BAN"]
)


@query(
    "quality_report",
    "check key value",
    "",
    f"""WITH {MBO_SQL} SELECT * FROM ({_checks(_QR)}) UNION ALL
    (SELECT 'symbol', instrument, CAST(count(*) AS DOUBLE) AS v FROM mbo GROUP BY 2 ORDER BY v DESC, 2 LIMIT 10)""",
)
def quality_report(spark, sf):
    return quality.quality_report(mbo(spark, sf))


_CF = (
    [("has", c, "max(1)") for c in ("ts_event", "price", "size", "side", "action")]
    + [("has", "channel_id", "max(0)"), ("rtype", "wrong", "count(*) FILTER (CASE WHEN flags = 0 THEN 0 ELSE 160 END <> 160)")]
    + [
        ("outside", "action", "count(*) FILTER (action NOT IN ('A','M','C','R','T','F','N'))"),
        ("outside", "side", "count(*) FILTER (side NOT IN ('B','A','N'))"),
        ("outside", "instrument", "count(*) FILTER (instrument NOT IN ('I0','I1'))"),
        ("range", "first_ts", "min(ts_event)"),
        ("range", "last_ts", "max(ts_event)"),
    ]
)


@query("schema_conformance", "check key value", "", f"WITH {MBO_SQL} SELECT * FROM ({_checks(_CF)})")
def schema_conformance(spark, sf):
    m = mbo(spark, sf).withColumn("rtype", F.when(F.col("flags") == 0, 0).otherwise(160))
    return quality.conformance(
        m, ["ts_event", "price", "size", "side", "action", "channel_id"], {"instrument": ["I0", "I1"]}
    )


@query(
    "processed_table_check",
    "column status filled",
    "",
    """SELECT * FROM (VALUES ('o_orderkey', 'ok'), ('o_custkey', 'ok'), ('o_orderstatus', 'ok'), ('o_totalprice', 'ok'),
        ('o_orderdate', 'extra'), ('o_orderpriority', 'extra')) AS t("column", status),
      (SELECT count(*) AS filled FROM orders)
    UNION ALL SELECT 'o_comment', 'missing', 0 UNION ALL SELECT 'o_void', 'all_null', 0""",
)
def processed_table_check(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_void", F.lit(None).cast("double"))
    return quality.processed_check(
        o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_comment", "o_void"]
    )


def _fq(c, e):
    return f"SELECT '{c}' AS feature, count(*) FILTER ({e} IS NULL) AS nulls, 0::BIGINT AS infs, coalesce(min({e}) = max({e}), true) AS constant FROM x"


@query(
    "feature_quality",
    "feature nulls infs constant",
    "",
    f"""WITH {MBO_SQL}, x AS (SELECT price, size, CASE WHEN side <> 'N' THEN size END AS sided, 7 AS fixed FROM mbo)
    {_fq('price', 'price')} UNION ALL {_fq('size', 'size')} UNION ALL {_fq('sided', 'sided')} UNION ALL {_fq('fixed', 'fixed')}""",
)
def feature_quality(spark, sf):
    m = mbo(spark, sf).select(
        "price", "size", F.when(F.col("side") != "N", F.col("size")).alias("sided"), F.lit(7).alias("fixed")
    )
    return quality.feature_quality(m, ["price", "size", "sided", "fixed"])


_PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]]


@query(
    "correlation_matrix",
    'left right',
    "corr",
    f"WITH {MBO_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS corr FROM mbo" for a, b in _PAIRS),
)
def correlation_matrix(spark, sf):
    return quality.correlation_pairs(mbo(spark, sf), NUMS)


@query(
    "correlated_groups",
    "grp feature",
    "",
    f"""WITH {MBO_SQL}, c AS (SELECT corr(price, value) AS c FROM mbo)
    SELECT CAST(0 AS BIGINT) AS grp, unnest(['price', 'value']) AS feature FROM c WHERE abs(c) >= 0.95""",
)
def correlated_groups(spark, sf):
    # the groups hold column names (k values), not rows
    groups = quality.correlated_groups(mbo(spark, sf), NUMS)
    rows = [(i, c) for i, g in enumerate(groups) for c in g]
    return spark.createDataFrame(rows, "grp long, feature string")


@query(
    "feature_correlation_rank",
    "feature",
    "abs_corr",
    f"WITH {MBO_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, value)) AS abs_corr FROM mbo" for c in ("price", "size", "flags", "sequence")),
)
def feature_correlation_rank(spark, sf):
    return quality.ranked_by_target(mbo(spark, sf), ["price", "size", "flags", "sequence"], "value")


@query(
    "raw_processed_comparison",
    "raw_rows processed_rows raw_volume processed_volume raw_columns processed_columns",
    "kept_share",
    f"""WITH {MBO_SQL} SELECT count(*) AS raw_rows, CAST(sum(size) AS BIGINT) AS raw_volume,
      count(*) FILTER (action = 'F') AS processed_rows, CAST(sum(size) FILTER (action = 'F') AS BIGINT) AS processed_volume,
      14 AS raw_columns, 8 AS processed_columns, count(*) FILTER (action = 'F') / count(*) AS kept_share FROM mbo""",
)
def raw_processed_comparison(spark, sf):
    from tickloom.functions.canonical import executions

    m = mbo(spark, sf)
    return quality.compare_tables(m, executions(m).withColumn("size", F.col("size").cast("long")))


LEVELS = """lv AS (SELECT instrument, trade_date, price, sum(size) AS volume FROM mbo GROUP BY ALL),
    cut AS (SELECT instrument, trade_date, quantile_cont(volume, 0.9) AS cut FROM lv GROUP BY ALL),
    top AS (SELECT lv.* FROM lv JOIN cut USING (instrument, trade_date) WHERE volume > cut),
    now AS (SELECT instrument, trade_date, arg_max(price, (ts_event, sequence)) AS last_price FROM mbo GROUP BY ALL),
    ob AS (SELECT n.instrument, n.trade_date, last_price, max(price) FILTER (price < last_price) AS support_level,
        min(price) FILTER (price > last_price) AS resistance_level,
        coalesce(arg_max(volume, price) FILTER (price < last_price) / max(volume), 0) AS support_confidence,
        coalesce(arg_min(volume, price) FILTER (price > last_price) / max(volume), 0) AS resistance_confidence
      FROM now n LEFT JOIN top USING (instrument, trade_date) GROUP BY ALL)"""
ICEBERG = """mv AS (SELECT *, abs((price - lag(price) OVER w) / lag(price) OVER w) AS move FROM mbo
      WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY ts_event, sequence)),
    ib AS (SELECT instrument, trade_date, coalesce((sum(size) FILTER (side = 'B') - sum(size) FILTER (side = 'A'))
        / nullif(sum(size) FILTER (side IN ('A', 'B')), 0), 0) AS im, coalesce(avg(move), 0) AS mm FROM
        (SELECT instrument, trade_date, move, side, size FROM mv UNION ALL
         SELECT DISTINCT instrument, trade_date, CAST(NULL AS DOUBLE), s, 0 FROM mv, (VALUES ('A'), ('B')) AS v(s)) GROUP BY ALL),
    ice AS (SELECT instrument, trade_date, im, least(abs(im) * (1 - mm), 1) AS iceberg_confidence FROM ib)"""
ABSORB = """ab0 AS (SELECT *, (price - lag(price) OVER w) / lag(price) OVER w AS chg, lead(price) OVER w AS nxt,
      last_value(price) OVER (PARTITION BY instrument, trade_date ORDER BY ts_event, sequence ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS fin
      FROM mbo WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY ts_event, sequence)),
    ab1 AS (SELECT *, coalesce(abs(chg) > 0.001 AND nxt IS NOT NULL AND ((chg > 0 AND fin < price) OR (chg < 0 AND fin > price)), false) AS hit FROM ab0),
    ab AS (SELECT instrument, trade_date, count(*) FILTER (hit) AS absorption_signals,
      CAST(coalesce(sum(size) FILTER (hit), 0) AS BIGINT) AS absorption_volume,
      CASE WHEN count(*) FILTER (hit) > 0 THEN least(avg(size) FILTER (hit) / avg(size), 1) ELSE 0 END AS absorption_confidence
      FROM ab1 GROUP BY ALL)"""
BY = ["instrument", "trade_date"]


@query(
    "volume_by_price_topk",
    "instrument price_level volume rank",
    "",
    f"""WITH {MBO_SQL}, v AS (SELECT instrument, CAST(price * 100 AS BIGINT) AS price_level, CAST(sum(size) AS BIGINT) AS volume FROM mbo GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY instrument ORDER BY volume DESC, price_level) AS INTEGER) AS rank FROM v
    QUALIFY rank <= 10""",
)
def volume_by_price_topk(spark, sf):
    from pyspark.sql import Window

    v = patterns.volume_by_price(mbo(spark, sf), ["instrument"])
    v = v.withColumn("price_level", (F.col("price") * 100).cast("long"))
    w = Window.partitionBy("instrument").orderBy(F.desc("volume"), "price_level")
    return v.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


@query(
    "support_resistance",
    "instrument trade_date",
    "last_price support_level resistance_level support_confidence resistance_confidence order_block_confidence",
    f"WITH {MBO_SQL}, {LEVELS} SELECT *, greatest(support_confidence, resistance_confidence) AS order_block_confidence FROM ob",
)
def support_resistance(spark, sf):
    return patterns.order_blocks(mbo(spark, sf), BY)


@query(
    "iceberg_window_score",
    "instrument trade_date",
    "iceberg_buy iceberg_sell iceberg_confidence",
    f"""WITH {MBO_SQL}, {ICEBERG} SELECT instrument, trade_date, iceberg_confidence,
      CASE WHEN im > 0 THEN iceberg_confidence ELSE 0 END AS iceberg_buy,
      CASE WHEN im < 0 THEN iceberg_confidence ELSE 0 END AS iceberg_sell FROM ice""",
)
def iceberg_window_score(spark, sf):
    m = mbo(spark, sf)
    return patterns.iceberg_score(m, BY, mbo_order(m))


@query(
    "absorption_window_score",
    "instrument trade_date absorption_signals absorption_volume",
    "absorption_confidence",
    f"WITH {MBO_SQL}, {ABSORB} SELECT * FROM ab",
)
def absorption_window_score(spark, sf):
    m = mbo(spark, sf)
    return patterns.absorption_score(m, BY, mbo_order(m))


@query(
    "pattern_confidence",
    "instrument trade_date",
    "overall_pattern_confidence",
    f"""WITH {MBO_SQL}, {LEVELS}, {ICEBERG}, {ABSORB} SELECT instrument, trade_date,
      (iceberg_confidence + greatest(support_confidence, resistance_confidence) + absorption_confidence) / 3 AS overall_pattern_confidence
    FROM ice JOIN ob USING (instrument, trade_date) JOIN ab USING (instrument, trade_date)""",
)
def pattern_confidence(spark, sf):
    m = mbo(spark, sf)
    return patterns.pattern_confidence(m, BY, mbo_order(m))
