"""Targets, sequences and time-aware splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.cols import flag, full, safe_div
from tickloom.operators.filters import session_label
from tickloom.order import EventOrder, Frames, number_rows, running, windowed


def horizon_targets(df: DataFrame, order: EventOrder, horizons: tuple[int, ...] = (1, 3, 5), price: str = "price") -> DataFrame:
    """Change, return, direction and volatility over the next h rows."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        p = F.col(price)
        cols = {}
        for h in horizons:
            ahead = F.lead(price, h).over(f.ordered())
            ret = safe_div(ahead - p, p)
            nxt = f.between(1, h)
            cols |= {
                f"price_change_{h}r": ahead - p,
                f"price_return_{h}r": ret,
                f"price_direction_{h}r": flag(ret > 0),
                f"price_volatility_{h}r": full(F.stddev_samp(price).over(nxt), nxt, h) if h > 1 else F.lit(0.0),
            }
        return d.withColumns(cols)

    return windowed(df, order, body, before=0, after=max(horizons))


def log_return_target(df: DataFrame, order: EventOrder, k: int, out: str = "target", price: str = "price") -> DataFrame:
    """100 * log(price k rows ahead / price)."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumn(out, 100 * F.log(F.lead(price, k).over(f.ordered()) / F.col(price)))

    return windowed(df, order, body, before=0, after=k)


def minute_targets(df: DataFrame, order: EventOrder, minutes: tuple[int, ...] = (1, 5, 15), rows_per_minute: int = 60) -> DataFrame:
    """Return and direction ``rows_per_minute * m`` rows ahead."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        cols = {}
        for m in minutes:
            ahead = F.lead("price", rows_per_minute * m).over(f.ordered())
            cols[f"return_target_{m}m"] = safe_div(ahead - F.col("price"), F.col("price"))
            cols[f"direction_target_{m}m"] = F.signum(ahead - F.col("price"))
        return d.withColumns(cols)

    return windowed(df, order, body, before=0, after=rows_per_minute * max(minutes))


def change_from_last_fill(df: DataFrame, order: EventOrder, k: int = 10) -> DataFrame:
    """Percent change of the price k events ahead against the last fill so far."""
    order = order.measured(df)
    d = running(df, order, {"_fill": ("last", F.when(F.col("action") == "F", F.col("price")))})

    def body(x: DataFrame, f: Frames) -> DataFrame:
        ahead = F.lead("price", k).over(f.ordered())
        return x.withColumn("target_pct", safe_div(ahead - F.col("_fill"), F.col("_fill")) * 100)

    return windowed(d, order, body, before=0, after=k).drop("_fill")


def three_class(df: DataFrame, order: EventOrder, threshold: float = 1e-4, k: int = 1) -> DataFrame:
    """Label 2 up, 0 down, 1 flat from the return k rows ahead."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        r = safe_div(F.lead("price", k).over(f.ordered()) - F.col("price"), F.col("price"))
        return d.withColumn("label", F.when(r > threshold, 2).when(r < -threshold, 0).when(r.isNotNull(), 1))

    return windowed(df, order, body, before=0, after=k)


def sequences(df: DataFrame, order: EventOrder, features: list[str], n: int) -> DataFrame:
    """The n rows before each row as an array of structs; rows without n are left out."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumn("sequence_window", F.collect_list(F.struct(*features)).over(f.between(-n, -1)))

    return windowed(df, order, body, before=n).filter(F.size("sequence_window") == n)


def time_split(df: DataFrame, order: EventOrder, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """``split`` by position in time within each key."""
    order = order.measured(df)
    d = number_rows(df, order, "_rn")
    n = d.groupBy(*order.keys).agg(F.max("_rn").alias("_n"))
    d = d.join(n, list(order.keys))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val))
    return d.withColumn("split", F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= b, "val").otherwise("test")).drop("_rn", "_n")


def stable_percent(key: Column, seed: int) -> Column:
    """0..99 from the text of a key; the same on every engine and every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def random_split(df: DataFrame, key: Column, seed: int = 42, train: int = 80) -> DataFrame:
    return df.withColumn("split", F.when(stable_percent(key, seed) < train, "train").otherwise("test"))


def _shuffled_roles(keys: DataFrame, name: str, seed: int, train: float, val: float) -> DataFrame:
    """Roles for a small set of distinct keys in seeded random order."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    w = Window.partitionBy(F.lit(1)).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"))))
    d = keys.withColumns({"_i": F.row_number().over(w), "_n": n})
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * val)
    role = F.when(F.col("_i") <= a, "train").when(F.col("_i") <= b, "val").otherwise("test")
    return d.select(name, role.alias(f"{name}_role"))


def session_split(df: DataFrame, seed: int = 42, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Split by shuffled sessions and shuffled dates; rows whose session and date fall
    into different splits get no split (NULL) and can be counted or dropped.

    Dates and sessions are a few thousand rows at most, so their tables are broadcast.
    """
    d = df.withColumn("session", session_label())
    s = _shuffled_roles(d.select("session").distinct(), "session", seed, train, val)
    t = _shuffled_roles(d.select("trade_date").distinct(), "trade_date", seed, train, val)
    d = d.join(F.broadcast(s), "session").join(F.broadcast(t), "trade_date")
    same = F.col("session_role") == F.col("trade_date_role")
    return d.withColumn("split", F.when(same, F.col("session_role"))).drop("session_role", "trade_date_role")


def walk_forward_dates(df: DataFrame, window: int = 30, step: int = 7) -> DataFrame:
    """(period, role) for every row of every walk-forward period over the dates.

    Training covers the first window - step + 1 dates, validation the rest of the
    window, testing the step dates after it.
    """
    dates = df.select("trade_date").distinct()
    w = Window.partitionBy(F.lit(1))
    dates = dates.withColumns(
        {"_d": F.row_number().over(w.orderBy("trade_date")) - 1, "_n": F.count(F.lit(1)).over(w)}
    )
    # periods whose window covers the date: start = period * step
    last = F.floor((F.col("_n") - window - 1) / step)
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.expr("array()").cast("array<bigint>"))
    p = dates.withColumn("period", F.explode(starts)).withColumn("_k", F.col("_d") - F.col("period") * step)
    role = (
        F.when(F.col("_k").between(0, window - step), "train")
        .when(F.col("_k").between(window - step + 1, window), "val")
        .when(F.col("_k").between(window + 1, window + step), "test")
    )
    table = p.withColumn("role", role).filter(F.col("role").isNotNull()).select("trade_date", "period", "role")
    return df.join(F.broadcast(table), "trade_date")


def row_slices(n: int, train: float = 0.6, val: float = 0.2, min_rows: int = 100) -> list[tuple[int, int, int]]:
    """(start, train end, validation end) of row-based walk-forward slices; the rest is
    the test slice. Short inputs give one slice."""
    a, b = int(n * train), int(n * (train + val))
    whole = [(0, a, b)]
    if n < min_rows:
        return whole
    step, width = max(min_rows, int(n * 0.1)), int(n * train) + int(n * val)
    starts = [s for s in range(0, n, step) if s + width < n and (s == 0 or s + b < n)]
    return [(s, s + a, s + width) for s in starts] or whole


def walk_forward_rows(df: DataFrame, order: EventOrder, train: float = 0.6, val: float = 0.2, min_rows: int = 100) -> DataFrame:
    """(period, role) by row position; a row appears once per period it belongs to.

    Slices are those of ``row_slices`` for the number of rows of each key.
    """
    order = order.measured(df)
    whole = lambda x: F.floor(x).cast("long")
    n = F.col("_n")
    a, b = whole(n * train), whole(n * (train + val))
    width, step = whole(n * train) + whole(n * val), F.greatest(F.lit(min_rows).cast("long"), whole(n * 0.1))
    starts = F.filter(F.sequence(F.lit(0).cast("long"), n - 1, step), lambda s: (s + width < n) & ((s == 0) | (s + b < n)))
    sliced = (n >= min_rows) & (F.size(starts) > 0)
    slices = F.when(sliced, F.transform(starts, lambda s: F.struct(s.alias("s"), (s + a).alias("m"), (s + width).alias("e")))).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("s"), a.alias("m"), b.alias("e")))
    )
    sizes = df.groupBy(*order.keys).agg(F.count(F.lit(1)).alias("_n")).select(*order.keys, slices.alias("_slices"))
    d = number_rows(df, order, "_rn").join(sizes, list(order.keys)).withColumn("_i", F.col("_rn") - 1)
    i = F.col("_i")
    d = d.select("*", F.posexplode("_slices").alias("period", "_at")).where(i >= F.col("_at.s"))
    role = F.when(i < F.col("_at.m"), "train").when(i < F.col("_at.e"), "val").otherwise("test")
    return d.withColumn("role", role).drop("_slices", "_at", "_rn", "_i")
