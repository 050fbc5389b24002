"""Row numbers in a total order without gathering a group anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import pin

_INDEX_BITS = 33  # monotonically_increasing_id: partition above, position in it below


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with a dense number from 1 within ``by`` (non-null columns; [] for the whole table) in ``order``.

    Rows are dealt by ranges of (by, order), so a group of any size spreads over many tasks; a
    row's place in its range is its number less that of its group's first row there, plus the
    rows of the group in earlier ranges. Rows equal in all of ``order`` share a task: callers
    end ``order`` with a column that differs. ``df`` is read twice (bounds, rows): pin it if dear.
    """
    ranged = df.repartitionByRange(*by, *order) if by or order else df
    ranged = pin(ranged.sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", _INDEX_BITS))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one group reaches over each range bound: no more rows than groups and ranges together
    firsts = ranged.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    firsts = firsts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    placed = ranged.join(firsts, [*by, "_part"])
    return placed.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")
