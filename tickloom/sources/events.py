"""Reading and writing event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.canonical import MBO_SCHEMA, canonicalise
from tickloom.session import pin

PARTITIONS = ("schema", "trade_date")


def read_events(
    spark: SparkSession,
    path: str | list[str],
    fmt: str | None = None,
    columns: list[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet, CSV, JSON or ORC by suffix or ``fmt``. Pass ``columns`` to prune the scan."""
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or next((s for s in ("parquet", "csv", "json", "orc") if f".{s}" in first.lower()), "parquet")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    if fmt in ("csv", "json"):
        reader = reader.schema(schema or MBO_SCHEMA)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    return df.select(*columns) if columns else df


def write_events(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None, mode: str = "error") -> None:
    """Snappy Parquet (or CSV/JSON), partitioned; overwrites touch only written partitions."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "parquet":
        writer = writer.option("compression", "snappy").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def with_source_date(df: DataFrame, pattern: str = r"(\d{8})", part: str = "file_name") -> DataFrame:
    """The date in the name (or, with ``part="file_path"``, the path) of the file each row came from."""
    name = F.regexp_extract(F.col(f"_metadata.{part}"), pattern, 1)
    return df.select("*", F.try_to_timestamp(F.nullif(name, F.lit("")), F.lit("yyyyMMdd")).cast("date").alias("source_date"))


def date_range(df: DataFrame, start: str, end: str, column: str = "trade_date") -> DataFrame:
    """Inclusive date range; on a partition column this prunes directories."""
    return df.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def first_events(df: DataFrame, n: int = 500) -> DataFrame:
    """The first n events in replay order (a sampling operator: top-n per task, then merge)."""
    return df.orderBy("ts_event", "sequence").limit(n)


def missing_partitions(df: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Rows of partitions that are not stored yet."""
    return df.join(existing.select(*on).distinct(), on, "left_anti")


def materialise(
    spark: SparkSession,
    raw: DataFrame,
    path: str,
    schema_name: str,
    build,
    trading_hours_only: bool = False,
) -> DataFrame:
    """Raw events to a stored feature table, one job for all dates; stored dates are
    skipped. Returns the stored table.

    A date counts as stored once a marker next to the table names it. Markers follow the
    data and a rerun overwrites the dates it writes, so what a failed job left is replaced."""
    from tickloom.operators.filters import trading_hours

    events = canonicalise(raw)
    if trading_hours_only:
        events = trading_hours(events)
    marks = f"{path}/_stored_dates/{schema_name}"
    try:
        events = missing_partitions(events, spark.read.parquet(marks), ["trade_date"])
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    out = build(events).withColumn("schema", F.lit(schema_name))
    new = pin(events.select("trade_date").distinct())  # before the markers change what is missing
    write_events(out, path, by=list(PARTITIONS), mode="overwrite")
    new.write.mode("append").parquet(marks)
    return spark.read.parquet(path).filter(F.col("schema") == schema_name)


def union_dates(frames: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_lineage(df: DataFrame, source: str, version: str = "1.0.0") -> DataFrame:
    """Conversion metadata columns next to the data."""
    return df.select(
        "*",
        F.lit(source).alias("source_name"),
        F.lit(version).alias("schema_version"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_size").alias("source_bytes"),
        F.current_timestamp().alias("converted_at"),
    )


def save_tables(tables: dict[str, DataFrame], base: str, mode: str = "overwrite") -> dict[str, str]:
    """Store each named table under ``base``; returns the paths."""
    paths = {name: f"{base}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode(mode).option("compression", "snappy").parquet(paths[name])
    return paths
