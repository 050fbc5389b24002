"""Joins between events, orders, books and tables of split points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.order import EventOrder, running


def level_totals(df: DataFrame, level: str, size: str, out: str, by: list[str]) -> DataFrame:
    """Each row with the total size of its price level.

    The totals are combined map-side first; the join back lets AQE split hot levels.
    """
    totals = df.groupBy(*by, level).agg(F.sum(size).alias(out))
    return df.join(totals, [*by, level])


def features_with_targets(features: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    return features.join(targets, on, "inner")


def order_lifecycle(df: DataFrame, keys: tuple[str, ...] = ("instrument", "order_id")) -> DataFrame:
    """One row per order: placement, modifications, fills, cancel, lifetime.

    A grouped aggregate with map-side combine: no self-join and no collected history.
    """
    at = F.struct("ts_event", "sequence")
    is_ = lambda a: F.col("action") == a
    out = df.groupBy(*keys).agg(
        F.min(F.when(is_("A"), F.col("ts_event"))).alias("added_ts"),
        F.min_by("price", F.when(is_("A"), at)).alias("added_price"),
        F.min_by("size", F.when(is_("A"), at)).alias("added_size"),
        F.min_by("side", F.when(is_("A"), at)).alias("side"),
        F.count_if(is_("M")).alias("modifications"),
        F.count_if(is_("F")).alias("fills"),
        F.sum(F.when(is_("F"), F.col("size")).otherwise(0)).alias("filled_size"),
        F.max(F.when(is_("C"), F.col("ts_event"))).alias("cancelled_ts"),
        F.min("ts_event").alias("first_ts"),
        F.max("ts_event").alias("last_ts"),
        F.count(F.lit(1)).alias("events"),
    )
    return out.withColumns(
        {
            "lifetime_ns": F.col("last_ts") - F.col("first_ts"),
            "fill_ratio": F.col("filled_size") / F.nullif(F.col("added_size"), F.lit(0)),
        }
    )


def asof_last(
    left: DataFrame,
    right: DataFrame,
    values: list[str],
    order: EventOrder,
    strict: bool = False,
) -> DataFrame:
    """Each left row with the newest right values at (or, strict, before) its time.

    Both sides are stacked and scanned once: no range join, no pairs.
    """
    own = [c for c in left.columns if c not in values]
    tag = F.lit(0 if strict else 1)
    # order: right rows before left rows at the same clock unless strict
    a = left.select(*own, tag.alias("_side"), F.lit(True).alias("_is_left"))
    b = right.select(
        *order.keys,
        *order.order,
        *[F.col(v).alias(f"_r_{v}") for v in values],
        (1 - tag).alias("_side"),
        F.lit(False).alias("_is_left"),
        F.lit(True).alias("_present"),
    )
    stacked = a.unionByName(b, allowMissingColumns=True)
    clock = EventOrder(
        keys=order.keys,
        order=(order.ts, "_side", *[c for c in order.order if c != order.ts]),
        ts=order.ts,
        hot=order.hot,
        cell_rows=order.cell_rows,
    )
    packed = F.when(F.col("_present"), F.struct(*[F.col(f"_r_{v}").alias(v) for v in values]))
    out = running(stacked.withColumn("_packed", packed), clock, {"_found": ("last", "_packed")})
    return out.filter("_is_left").select(*own, *[F.col(f"_found.{v}").alias(v) for v in values])


def semi_by_split(df: DataFrame, splits: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose split is listed. The size of the list in bytes, known once its
    ``distinct`` has run, lets AQE choose between a broadcast and a shuffle."""
    return df.join(splits.select(*on).distinct(), on, "left_semi")


def anti_processed(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return df.join(done.select(*on).distinct(), on, "left_anti")


def by_position(left: DataFrame, right: DataFrame, order: EventOrder) -> DataFrame:
    """Rows matched on the unique event key (what array code does by position)."""
    keys = [*order.keys, *order.order]
    return left.join(right, keys, "inner")


