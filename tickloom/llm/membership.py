"""Bounded bitmaps that keep rows without a partner out of shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_VALUE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # 128 KB to 32 MB: the bound of what is broadcast


def _slot(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits).cast("long"))


def maybe_in(df: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``values.name``: all that are, and few others.

    One bit per hashed value, 4 KB a row, at most ``MOST_BITS`` in all: a broadcast of
    bounded size at any input. Beyond that bound more other rows pass, so the exact join
    that must follow stays right. Rows with a null value go.
    """
    count = values.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_VALUE * count).bit_length()))
    at = values.where(F.col(name).isNotNull()).select(_slot(F.col(name), bits).alias("h"))
    maps = at.groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_map"))
    held = df.where(F.col(column).isNotNull()).withColumn("_slot", _slot(F.col(column), bits))
    held = held.withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(maps), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_map, CAST(bitmap_bit_position(_slot) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("CAST(bitmap_bit_position(_slot) % 8 AS INT)")
    return held.where(F.getbit(byte, bit) == 1).drop("_slot", "_bucket", "_map")
