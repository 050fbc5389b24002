"""Exponential averages as window expressions.

Inside a block of B rows the recursion unrolls to a weighted prefix sum,
``y_p = q^p * sum(x_i * q^-i)``; B is chosen so that q^-B stays inside a double and
q^B vanishes below its precision. A row therefore needs its own block and the one
before it, nothing earlier: a bounded look-back with exact double results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.fast import per_group
from tickloom.order import EventOrder, Frames, join_null_safe, number_rows

_GROWTH = 300.0
_PRECISION = 45.0  # e^-45 vanishes beside any value of the average


def block_rows(alpha: float) -> int:
    return max(2, int(_GROWTH / -math.log1p(-alpha)))


def reach(*alphas: float) -> int:
    """Rows of history an average needs to be exact to double precision."""
    return max(2 * block_rows(a) for a in alphas)


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def ema(df: DataFrame, f: Frames, specs: dict[str, tuple[Column | str, float, bool | None]]) -> DataFrame:
    """Add averages ``{out: (column, alpha, adjust)}``.

    adjust=True divides by the sum of the weights seen so far; adjust=False is the
    recursion seeded by the first value; adjust=None is the recursion started at 0.
    Inputs must not be null.
    """
    rn = F.row_number().over(f.ordered())
    out = df.withColumn("_k", (rn - 1).cast("long"))
    for name, (column, alpha, adjust) in specs.items():
        x = F.col(column) if isinstance(column, str) else column
        size = block_rows(alpha)
        decay = math.log1p(-alpha)
        pos = F.col("_k") % size
        seed = F.lit(1.0) if adjust is not False else F.when(F.col("_k") == 0, F.lit(1.0 / alpha)).otherwise(1.0)
        out = out.withColumns({"_blk": F.expr(f"_k div {size}"), "_pos": pos})
        out = out.withColumn("_w", x * seed * F.exp(-F.col("_pos") * F.lit(decay)))
        inside = Window.partitionBy(*f.keys, "_blk").orderBy(*f.order).rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy(*f.keys).orderBy("_blk").rangeBetween(-1, -1)
        out = out.withColumns(
            {
                "_own": F.sum("_w").over(inside) * F.exp(F.col("_pos") * F.lit(decay)),
                "_prev": F.sum("_w").over(earlier) * F.exp(F.lit((size - 1) * decay)),
            }
        )
        total = F.col("_own") + F.coalesce(F.col("_prev"), F.lit(0.0)) * F.exp((F.col("_pos") + 1) * F.lit(decay))
        if adjust:
            weights = (1 - F.exp((F.col("_k") + 1) * F.lit(decay))) / F.lit(alpha)
            out = out.withColumn(name, total / weights)
        else:
            out = out.withColumn(name, total * F.lit(alpha))
        out = out.drop("_blk", "_pos", "_w", "_own", "_prev")
    return out.drop("_k")


def ema_in_cells(df: DataFrame, order: EventOrder, column: str, alphas: dict[str, float]) -> DataFrame:
    """Averages started at 0 (``{out: alpha}``) of keys cut into cells, however far they reach back.

    A cell's own average starts at 0 as well; what the cells before it leave behind is added,
    each with its weight. Cells whose weight vanishes below double precision are not read.
    """
    size, keys = order.rows_per_cell(df, 1), list(order.keys)
    decay = {n: math.log1p(-a) for n, a in alphas.items()}
    d = number_rows(df, order, "_n").withColumns({"_cell": F.expr(f"(_n - 1) div {size}"), "_pos": F.expr(f"(_n - 1) % {size}")}).drop("_n")
    left = {n: F.sum(F.col(column) * F.exp((size - 1 - F.col("_pos")) * F.lit(c))).alias(f"_left_{n}") for n, c in decay.items()}
    cells = d.groupBy(*keys, "_cell").agg(*left.values())

    def carry(n: str, c: float) -> Column:
        earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(-max(1, math.ceil(_PRECISION / (-c * size))), -1)
        states = F.collect_list(F.struct(F.col("_cell").alias("cell"), F.col(f"_left_{n}").alias("left"))).over(earlier)
        return F.aggregate(states, F.lit(0.0), lambda a, x: a + x["left"] * F.exp((F.col("_cell") - 1 - x["cell"]) * F.lit(size * c)))

    carried = cells.select(*keys, "_cell", *[carry(n, c).alias(f"_carry_{n}") for n, c in decay.items()])

    def fn(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = pd.Series(np.concatenate([[0.0], g[column]]))
        return {n: x.ewm(alpha=a, adjust=False).mean().to_numpy()[1:] for n, a in alphas.items()}

    own = per_group(d, order.frames("_cell"), {n: "double" for n in alphas}, fn, [column])
    out = join_null_safe(own, carried, [*keys, "_cell"], "left")
    add = {n: F.col(n) + F.lit(a) * F.col(f"_carry_{n}") * F.exp((F.col("_pos") + 1) * F.lit(decay[n])) for n, a in alphas.items()}
    return out.withColumns(add).drop("_cell", "_pos", *[f"_carry_{n}" for n in alphas])
