"""Exact quantiles, bins and ranks over whole tables without one-task collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.order import EventOrder, running


def _value_runs(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values with their cumulative counts per group (``_upto`` inclusive).

    Equal values are combined before the shuffle; the scan over distinct values is
    the skew-safe running sum.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    keys = tuple(by) or ("_all",)
    return running(counts, EventOrder(keys=keys, order=(value,), ts=value), {"_upto": ("sum", "_n")})


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """One row per group with linearly interpolated quantiles ``{name: q}``."""
    by = list(by or [])
    keys = by or ["_all"]
    runs = _value_runs(df, value, by)
    totals = runs.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    placed = runs.join(totals, keys).withColumn("_from", F.col("_upto") - F.col("_n"))

    def at(rank: Column) -> Column:
        hit = (F.col("_from") <= rank) & (F.col("_upto") > rank)
        return F.max(F.when(hit, F.col(value)))

    aggs = []
    for i, (_, q) in enumerate(qs.items()):
        pos = (F.col("_total") - 1) * F.lit(float(q))
        aggs += [
            at(F.floor(pos)).alias(f"_lo{i}"),
            at(F.ceil(pos)).alias(f"_hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"_w{i}"),
        ]
    out = placed.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name)
        for i, name in enumerate(qs)
    ]
    return out.select(*by, *cols)


def quantile_bins(
    df: DataFrame, value: str, out: str, n: int, by: list[str] | None = None, fit: str | None = None
) -> DataFrame:
    """0-based quantile bin of each row (right-closed, duplicate edges dropped).

    Edges come from ``fit`` when given, so they can be learnt on past rows only;
    values outside the learnt range fall into the outer bins.
    """
    by = list(by or [])
    names = {f"_e{i}": i / n for i in range(n + 1)}
    edges = exact_quantiles(df, fit or value, names, by)
    edges = edges.select(*by, F.array_distinct(F.array(*names)).alias("_edges"))
    joined = df.join(edges, by, "left") if by else df.crossJoin(F.broadcast(edges))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    inside = F.least(F.greatest(below - 1, F.lit(0)), F.size("_edges") - 2)
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), inside)).drop("_edges")


def equal_width_bins(df: DataFrame, value: str, out: str, n: int, by: list[str] | None = None) -> DataFrame:
    """0-based right-closed equal-width bin over the group's own range."""
    by = list(by or [])
    span = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(span, by) if by else df.crossJoin(F.broadcast(span))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n))
    place = F.when(step > 0, F.ceil((F.col(value) - F.col("_lo")) / step) - 1).otherwise(0)
    return joined.withColumn(out, F.least(F.greatest(place, F.lit(0)), F.lit(n - 1)).cast("int")).drop("_lo", "_hi")


def ranked(df: DataFrame, by: list[str], order_by: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(*order_by)))
