"""Bars, footprints and profiles: grouped aggregates over event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.canonical import executions
from tickloom.functions.cols import clip


def signed_size(side: Column | str = "side", size: Column | str = "size", convention: str = "aggressor") -> Column:
    """+size for B, -size for A, 0 for N; ``resting`` reverses the sign."""
    side = F.col(side) if isinstance(side, str) else side
    size = F.col(size) if isinstance(size, str) else size
    sign = F.when(side == "B", 1).when(side == "A", -1).otherwise(0)
    return size * (sign if convention == "aggressor" else -sign)


def _with_clock(df: DataFrame) -> DataFrame:
    if "ts" in df.columns and dict(df.dtypes)["ts"].startswith("timestamp"):
        return df.withColumn("_at", F.col("ts").cast("timestamp"))
    return df.withColumn("_at", F.timestamp_micros(F.expr("ts_event div 1000")))


def ohlcv(df: DataFrame, rule: str, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """OHLCV bars; first and last price by (ts_event, sequence)."""
    at = F.struct("ts_event", "sequence")
    return (
        _with_clock(df)
        .groupBy(*keys, F.window("_at", rule).alias("_w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(*keys, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume")
    )


def ohlcv_of_fills(df: DataFrame, rule: str) -> DataFrame:
    return ohlcv(executions(df).drop("ts"), rule)


def ohlc_epoch(df: DataFrame, rule: str) -> DataFrame:
    """Bars keyed by the epoch second of their start."""
    bars = ohlcv(df, rule)
    return bars.withColumn("time", F.unix_timestamp("bar_start")).drop("bar_start")


def footprint(df: DataFrame, minutes: int, keep_empty: bool = False, convention: str = "aggressor") -> DataFrame:
    """OHLC, volume, delta and delta ratio per window; empty windows on request."""
    at = F.struct("ts_event", "sequence")
    bars = (
        _with_clock(df)
        .withColumn("_d", signed_size(convention=convention))
        .groupBy("instrument", F.window("_at", f"{minutes} minutes").alias("_w"))
        .agg(
            F.bround(F.min_by("price", at), 2).alias("open"),
            F.bround(F.max("price"), 2).alias("high"),
            F.bround(F.min("price"), 2).alias("low"),
            F.bround(F.max_by("price", at), 2).alias("close"),
            F.sum("size").alias("volume"),
            F.sum("_d").alias("delta"),
        )
        .select("instrument", F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "delta")
    )
    bars = bars.withColumn("delta_ratio", F.when(F.col("volume") != 0, F.col("delta") / F.col("volume")).otherwise(0.0))
    if not keep_empty:
        return bars
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    grid = (
        bars.groupBy("instrument")
        .agg(F.min("bar_start").alias("a"), F.max("bar_start").alias("b"))
        .select("instrument", F.explode(F.sequence("a", "b", step)).alias("bar_start"))
    )
    return grid.join(bars, ["instrument", "bar_start"], "left").fillna(
        {"volume": 0, "delta": 0, "delta_ratio": 0.0}
    )


def clipped_delta(bars: DataFrame) -> DataFrame:
    """Delta over volume, clipped to [-1, 1]."""
    share = F.col("delta") / F.nullif(F.col("volume"), F.lit(0))
    return bars.withColumn("delta_norm", F.coalesce(clip(share, -1, 1), F.lit(0.0)))


def footprint_grid(df: DataFrame, rule: str, tick: float) -> DataFrame:
    """Buy, sell and delta per window and price level."""
    size_if = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0))
    return (
        _with_clock(df)
        .groupBy(
            "instrument",
            F.window("_at", rule).alias("_w"),
            F.round(F.col("price") / tick).cast("long").alias("level"),
        )
        .agg(size_if("B").alias("buy_volume"), size_if("A").alias("sell_volume"))
        .withColumn("delta", F.col("buy_volume") - F.col("sell_volume"))
        .select("instrument", F.col("_w.start").alias("bar_start"), "level", "buy_volume", "sell_volume", "delta")
    )


def volume_profile(bars: DataFrame, bins: int = 20) -> DataFrame:
    """Volume of bars that overlap each price bin, split by up and down bars.

    Bars are expanded to the bins they cover (at most ``bins`` each) instead of being
    joined on an inequality.
    """
    span = bars.groupBy("instrument").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = bars.join(span, "instrument").withColumn("_step", step)
    first = F.greatest(F.ceil((F.col("low") - F.col("_lo")) / F.col("_step")) - 1, F.lit(0))
    last = F.least(F.floor((F.col("high") - F.col("_lo")) / F.col("_step")), F.lit(bins - 1))
    flat = F.col("_step") <= 0
    b = b.withColumn("bin", F.explode(F.sequence(F.when(flat, 0).otherwise(first), F.when(flat, 0).otherwise(last))))
    up = F.col("close") >= F.col("open")
    return b.groupBy("instrument", "bin").agg(
        F.min(F.col("_lo") + F.col("bin") * F.col("_step")).alias("bin_low"),
        F.sum("volume").alias("volume"),
        F.sum(F.when(up, F.col("volume")).otherwise(0)).alias("up_volume"),
        F.sum(F.when(~up, F.col("volume")).otherwise(0)).alias("down_volume"),
    )


def volume_onto_bars(bars: DataFrame, volume: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a volume table, absent windows give 0."""
    return bars.join(volume, on, "left").withColumn("volume", F.coalesce(F.col("volume"), F.lit(0)))


def bar_summary(bars: DataFrame) -> DataFrame:
    """Return, range, bar directions and annualised volatility per instrument."""
    from pyspark.sql import Window

    w = Window.partitionBy("instrument").orderBy("bar_start")
    prev = F.lag("close").over(w)
    b = bars.withColumn("_ret", (F.col("close") - prev) / F.nullif(prev, F.lit(0.0)))
    first, last = F.min_by("open", "bar_start"), F.max_by("close", "bar_start")
    return b.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("bars"),
        ((last - first) / first * 100).alias("return_pct"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.count_if(F.col("close") > F.col("open")).alias("up_bars"),
        F.count_if(F.col("close") < F.col("open")).alias("down_bars"),
        F.count_if(F.col("close") == F.col("open")).alias("doji_bars"),
        (F.stddev_samp("_ret") * F.sqrt(F.lit(252.0)) * 100).alias("volatility_pct"),
    )
