"""How the supplied tables play the roles of the order-event model.

``events`` becomes an order-event table: one instrument per group of four users, one
resting order per (user, tens of k), prices on a 0.25 grid, sizes 1..100. The same
mapping is stated once as a Spark projection and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.order import EventOrder

TICK = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mbo(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The event table; ``where`` on stored columns reaches the Parquet scan."""
    e = table(spark, sf_dir, "events")
    return mbo_of(e if where is None else e.filter(where))


def mbo_of(e: DataFrame) -> DataFrame:
    """The projection itself, for batch and streaming event tables alike."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    ns = F.unix_micros(ts) * 1000
    return e.select(
        F.col("event_id").alias("sequence"),
        F.concat(F.lit("I"), (F.col("user_id") % 4).cast("string")).alias("instrument"),
        ns.alias("ts_event"),
        (ns + k * 1000).alias("ts_recv"),
        F.to_date(ts).alias("trade_date"),
        F.when((F.col("event_type") == "view") & (k == 99), "R")
        .when(F.col("event_type").isin("signup", "error"), "A")
        .when(F.col("event_type") == "click", "M")
        .when(F.col("event_type") == "view", "C")
        .otherwise("F")
        .alias("action"),
        F.when(k % 25 == 0, "N").when(F.col("event_id") % 2 == 0, "B").otherwise("A").alias("side"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(k / 10).cast("string")).alias("order_id"),
        (F.lit(100.0) + F.floor(F.col("value")) * F.lit(TICK)).alias("price"),
        (k + 1).cast("long").alias("size"),
        (F.col("event_id") % 256).cast("int").alias("flags"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("value"),
    )


MBO_SQL = """mbo AS (
  SELECT event_id AS sequence, 'I' || (user_id % 4) AS instrument,
    epoch_us(ts) * 1000 AS ts_event, epoch_us(ts) * 1000 + k * 1000 AS ts_recv,
    CAST(ts AS DATE) AS trade_date,
    CASE WHEN event_type = 'view' AND k = 99 THEN 'R' WHEN event_type IN ('signup', 'error') THEN 'A'
         WHEN event_type = 'click' THEN 'M' WHEN event_type = 'view' THEN 'C' ELSE 'F' END AS action,
    CASE WHEN k % 25 = 0 THEN 'N' WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side,
    user_id || '-' || (k // 10) AS order_id,
    100.0::DOUBLE + floor(value) * 0.25::DOUBLE AS price, CAST(k + 1 AS BIGINT) AS size,
    CAST(event_id % 256 AS INTEGER) AS flags, user_id, event_type, value, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

# Windows over one instrument in replay order, and over one instrument and day.
W = "PARTITION BY instrument ORDER BY ts_event, sequence"


def rows(n: int, by: str = W) -> str:
    return f"({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def span(start: int | None, end: int, by: str = W) -> str:
    def edge(v: int | None) -> str:
        if v is None:
            return "UNBOUNDED PRECEDING"
        if v == 0:
            return "CURRENT ROW"
        return f"{-v} PRECEDING" if v < 0 else f"{v} FOLLOWING"

    return f"({by} ROWS BETWEEN {edge(start)} AND {edge(end)})"


def trailing(ns: int, key: str = "instrument") -> str:
    return f"(PARTITION BY {key} ORDER BY ts_event RANGE BETWEEN {ns} PRECEDING AND CURRENT ROW)"


def strict(agg: str, col: str, n: int, by: str = W) -> str:
    """agg(col) over the last n rows, NULL until n non-null inputs were seen."""
    w = rows(n, by)
    return f"CASE WHEN count({col}) OVER {w} >= {n} THEN {agg.format(c=col)} OVER {w} END"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of one supplier: day clock, ties broken by order and line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("instrument"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_event"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("long").alias("size"),
        F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("N").alias("side"),
        F.when(F.col("l_linestatus") == "F", "F").otherwise("A").alias("action"),
    )


def mbo_order(df: DataFrame) -> EventOrder:
    return EventOrder().measured(df)
