"""Pattern scores over groups of events: order blocks, iceberg, absorption, flow report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import clip, pct_change
from tickloom.operators.quantiles import exact_quantiles
from tickloom.order import EventOrder, Frames, windowed


def volume_by_price(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "price").agg(F.sum("size").alias("volume"))


def order_blocks(df: DataFrame, by: list[str]) -> DataFrame:
    """Top-decile volume levels, nearest support and resistance with confidence."""
    levels = volume_by_price(df, by)
    cut = exact_quantiles(levels, "volume", {"_cut": 0.9}, by)
    now = df.groupBy(*by).agg(F.max_by("price", F.struct("ts_event", "sequence")).alias("last_price"))
    top = levels.join(cut, by).filter(F.col("volume") > F.col("_cut"))
    joined = now.join(top, by, "left")
    below, above = F.col("price") < F.col("last_price"), F.col("price") > F.col("last_price")
    out = joined.groupBy(*by).agg(
        F.max("last_price").alias("last_price"),
        F.max("volume").alias("_peak"),
        F.max(F.when(below, F.col("price"))).alias("support_level"),
        F.min(F.when(above, F.col("price"))).alias("resistance_level"),
        F.max_by("volume", F.when(below, F.col("price"))).alias("_sv"),
        F.min_by("volume", F.when(above, F.col("price"))).alias("_rv"),
    )
    sc = F.coalesce(clip(F.col("_sv") / F.col("_peak"), 0, 1), F.lit(0.0))
    rc = F.coalesce(clip(F.col("_rv") / F.col("_peak"), 0, 1), F.lit(0.0))
    return out.withColumns(
        {"support_confidence": sc, "resistance_confidence": rc, "order_block_confidence": F.greatest(sc, rc)}
    ).drop("_peak", "_sv", "_rv")


def iceberg_score(df: DataFrame, by: list[str], order: EventOrder) -> DataFrame:
    """Volume imbalance damped by the mean absolute price move of the group."""
    order = order.by(*by)

    def body(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumn("_move", F.abs(pct_change("price", f)))

    d = windowed(df, order, body, before=1)
    buy = F.sum(F.when(F.col("side") == "B", F.col("size")).otherwise(0))
    sell = F.sum(F.when(F.col("side") == "A", F.col("size")).otherwise(0))
    out = d.groupBy(*by).agg(buy.alias("buy"), sell.alias("sell"), F.avg("_move").alias("_move"))
    imbalance = F.coalesce((F.col("buy") - F.col("sell")) / F.nullif(F.col("buy") + F.col("sell"), F.lit(0)), F.lit(0.0))
    conf = F.least(F.abs(imbalance) * (1 - F.coalesce(F.col("_move"), F.lit(0.0))), F.lit(1.0))
    return out.select(
        *by,
        F.when(imbalance > 0, conf).otherwise(0.0).alias("iceberg_buy"),
        F.when(imbalance < 0, conf).otherwise(0.0).alias("iceberg_sell"),
        conf.alias("iceberg_confidence"),
    )


def absorption_score(df: DataFrame, by: list[str], order: EventOrder, move: float = 0.001) -> DataFrame:
    """Moves above ``move`` reversed within the next four rows, weighted by size."""
    order = order.by(*by)

    def body(d: DataFrame, f: Frames) -> DataFrame:
        last = F.last("price").over(f.between(0, 4))
        nxt = F.lead("price").over(f.ordered())
        change = pct_change("price", f)
        d = d.withColumns({"_chg": change, "_end": F.when(nxt.isNotNull(), last)})
        reversed_ = ((F.col("_chg") > 0) & (F.col("_end") < F.col("price"))) | (
            (F.col("_chg") < 0) & (F.col("_end") > F.col("price"))
        )
        return d.withColumn("_hit", F.coalesce((F.abs("_chg") > move) & reversed_, F.lit(False)))

    d = windowed(df, order, body, before=1, after=4)
    out = d.groupBy(*by).agg(
        F.count_if("_hit").alias("absorption_signals"),
        F.sum(F.when(F.col("_hit"), F.col("size")).otherwise(0)).alias("absorption_volume"),
        F.avg("size").alias("_mean"),
    )
    conf = F.when(
        F.col("absorption_signals") > 0,
        F.least(F.col("absorption_volume") / F.col("absorption_signals") / F.col("_mean"), F.lit(1.0)),
    ).otherwise(0.0)
    return out.withColumn("absorption_confidence", conf).drop("_mean")


def pattern_confidence(df: DataFrame, by: list[str], order: EventOrder) -> DataFrame:
    """Mean of iceberg, order-block and absorption confidence per group."""
    joined = (
        iceberg_score(df, by, order)
        .join(order_blocks(df, by), by)
        .join(absorption_score(df, by, order), by)
    )
    mean = (F.col("iceberg_confidence") + F.col("order_block_confidence") + F.col("absorption_confidence")) / 3
    return joined.withColumn("overall_pattern_confidence", mean)


def flow_report(df: DataFrame, by: str = "flow_classification") -> DataFrame:
    """Counts, volume, mean toxicity and risk per flow class."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("size").alias("volume"),
        F.avg("flow_toxicity_score").alias("mean_toxicity"),
        F.avg("flow_adverse_selection_risk").alias("adverse_selection_risk"),
        F.avg("flow_directional_persistence").alias("persistence"),
        F.avg("flow_size_aggressiveness").alias("size_aggressiveness"),
        F.avg("flow_timing_sophistication").alias("timing_sophistication"),
        F.avg("flow_information_content").alias("information_content"),
    )
