"""Small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.order import Frames


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den where den > 0, else ``default``."""
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (the NaN/inf of array libraries)."""
    return num / F.nullif(den, F.lit(0.0))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(cond, 1).otherwise(0)


def clip(c: Column, lo: float, hi: float) -> Column:
    """c held inside [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def full(value: Column, w: WindowSpec, n: int, on: Column | None = None) -> Column:
    """Keep a rolling value only once n non-null inputs are in the frame."""
    seen = F.count(F.lit(1) if on is None else on).over(w)
    return F.when(seen >= n, value)


def pct_change(c: Column | str, f: Frames, k: int = 1) -> Column:
    prev = F.lag(col(c), k).over(f.ordered())
    return safe_div(col(c) - prev, prev)


def roll(c: Column | str, f: Frames, n: int, how: str, strict: bool = True) -> Column:
    """Rolling aggregate over the last n rows. ``strict`` waits for n non-null rows."""
    x = col(c)
    w = f.rows(n)
    value = {
        "sum": F.sum,
        "mean": F.avg,
        "std": F.stddev_samp,
        "std_pop": F.stddev_pop,
        "min": F.min,
        "max": F.max,
        "count": F.count,
        "skew": F.skewness,
        "kurt": F.kurtosis,
    }[how](x).over(w)
    return full(value, w, n, x) if strict else value


def roll_quantile(c: Column | str, f: Frames, n: int, q: float, strict: bool = True) -> Column:
    """Exact rolling quantile with linear interpolation."""
    w = f.rows(n)
    value = F.percentile(col(c), F.lit(q)).over(w)
    return full(value, w, n, col(c)) if strict else value
