"""Price, size, time and depth normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import clip, col, ratio
from tickloom.functions.ema import ema, reach
from tickloom.functions.fast import extremes, rolling
from tickloom.order import EventOrder, Frames, windowed

HISTORY = 1000


def tick_relative(price: Column | str, mid: Column | str, tick: float) -> Column:
    return (col(price) - col(mid)) / F.lit(tick)


def tick_absolute(x: Column | str, mid: Column | str, tick: float) -> Column:
    return col(x) * F.lit(tick) + col(mid)


def log_relative(price: Column | str, mid: Column | str) -> Column:
    return F.when((col(price) > 0) & (col(mid) > 0), F.log(col(price) / col(mid))).otherwise(0.0)


def log_absolute(x: Column | str, mid: Column | str) -> Column:
    return F.exp(col(x)) * col(mid)


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    """Against a rolling mean and population deviation, 0 when flat."""
    return F.when(sd > 0, (x - mean) / sd).otherwise(0.0)


def zscore_absolute(z: Column, mean: Column, sd: Column) -> Column:
    return z * sd + mean


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.5)


def minmax_absolute(u: Column, lo: Column, hi: Column) -> Column:
    return u * (hi - lo) + lo


def with_history(d: DataFrame, f: Frames, column: str, tag: str, n: int = HISTORY) -> DataFrame:
    """Rolling mean, deviation, minimum and maximum of a column over n rows."""
    d = rolling(d, f, {f"{tag}_mean": (column, n, "mean"), f"{tag}_sd": (column, n, "std_pop")})
    return extremes(d, f, {f"{tag}_lo": (column, n, "min"), f"{tag}_hi": (column, n, "max")})


def size_against_baseline(size: Column | str, mean: Column, seen: Column) -> Column:
    """log1p(size) over log1p of the rolling mean size (1 until two sizes are known)."""
    base = F.when(seen > 1, mean).otherwise(1.0)
    return F.log1p(col(size).cast("double")) / F.log1p(F.greatest(base, F.lit(1.0)))


def depth_log(depth: Column | str) -> Column:
    return F.transform(col(depth), lambda x: F.when(x > 0, F.log1p(x.cast("double"))).otherwise(0.0))


def imbalance(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def squash(x: Column, alpha: float = 1.0) -> Column:
    return F.tanh(x * F.lit(alpha))


def normalise_events(df: DataFrame, order: EventOrder, tick: float, mid: str = "mid", mode: str = "tick") -> DataFrame:
    """price_norm, size_norm and time_delta_norm in one pass over one sort.

    mode: tick, log, zscore, minmax; with the last two all outputs are squashed with tanh.
    """

    def body(d: DataFrame, f: Frames) -> DataFrame:
        gap = F.col("ts_event") - F.lag("ts_event").over(f.ordered())
        d = d.withColumn("_gap", F.coalesce(gap, F.lit(0)).cast("double"))
        specs = {
            "_s_mean": ("size", HISTORY, "mean"),
            "_s_seen": ("size", HISTORY, "count"),
            "_g_mean": ("_gap", HISTORY, "mean"),
            "_g_sd": ("_gap", HISTORY, "std_pop"),
        }
        if mode == "zscore":
            specs |= {"_m_mean": (mid, HISTORY, "mean"), "_m_sd": (mid, HISTORY, "std_pop")}
        d = rolling(d, f, specs)
        if mode == "minmax":
            d = extremes(d, f, {"_m_lo": (mid, HISTORY, "min"), "_m_hi": (mid, HISTORY, "max")})
        price = {
            "tick": lambda: tick_relative("price", mid, tick),
            "log": lambda: log_relative("price", mid),
            "zscore": lambda: zscore(F.col("price"), F.col("_m_mean"), F.col("_m_sd")),
            "minmax": lambda: minmax(F.col("price"), F.col("_m_lo"), F.col("_m_hi")),
        }[mode]()
        out = {
            "price_norm": price,
            "size_norm": size_against_baseline("size", F.col("_s_mean"), F.col("_s_seen")),
            "time_delta_norm": zscore(F.col("_gap"), F.col("_g_mean"), F.col("_g_sd")),
        }
        if mode in ("zscore", "minmax"):
            out = {name: squash(c) for name, c in out.items()}
        return d.withColumns(out).drop("_gap", *specs, "_m_lo", "_m_hi")

    return windowed(df, order, body, before=HISTORY + 1)


def mid_averages(df: DataFrame, order: EventOrder, mid: str = "mid") -> DataFrame:
    """Fast, medium and slow recursive averages of the mid price (.1, .01, .001)."""
    alphas = {"mid_fast": 0.1, "mid_medium": 0.01, "mid_slow": 0.001}

    def body(d: DataFrame, f: Frames) -> DataFrame:
        return ema(d, f, {n: (mid, a, False) for n, a in alphas.items()})

    return windowed(df, order, body, before=reach(*alphas.values()))


def scored(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """Weighted sum of columns scaled to their whole-table range, clipped to [0, 1]."""
    bounds = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in weights], *[F.max(c).alias(f"_hi_{c}") for c in weights])
    terms = []
    for c, w in weights.items():
        scaled = (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 1e-8)
        terms.append(F.coalesce(scaled, F.lit(0.5)) * F.lit(w))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    return joined.withColumn(out, clip(total, 0, 1)).drop(*bounds.columns)


def robust_scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Centre on the median and divide by the interquartile range (exact)."""
    from tickloom.operators.quantiles import exact_quantiles

    out = df
    for c in cols:
        q = exact_quantiles(df, c, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
        width = F.col("_q3") - F.col("_q1")
        scaled = (F.col(c) - F.col("_q2")) / F.when(width == 0, 1.0).otherwise(width)
        out = out.crossJoin(F.broadcast(q)).withColumn(f"{c}_scaled", scaled).drop("_q1", "_q2", "_q3")
    return out


def standard_scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean and unit (population) deviation over the table."""
    aggs = [F.avg(c).alias(f"_m_{c}") for c in cols] + [F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    stats = df.agg(*aggs)
    out = df.crossJoin(F.broadcast(stats))
    sd = {c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}
    return out.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / sd[c] for c in cols}).drop(*stats.columns)
