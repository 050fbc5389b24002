"""File inventory: names, sizes, content hashes, duplicates, roll-ups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 8 << 20


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with what their names say; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.(zst|gz|zip|bz2|snappy)(\.|$)", 1))
    date = F.regexp_extract(name, r"(\d{4}-?\d{2}-?\d{2})", 1)
    return files.select(
        "path",
        name.alias("file_name"),
        "size",
        "modified",
        (suffix != "").alias("is_compressed"),
        F.nullif(suffix, F.lit("")).alias("compression_type"),
        F.nullif(F.regexp_replace(date, "-", ""), F.lit("")).alias("date"),
        F.element_at(F.split(name, r"[-_.]"), 1).alias("dataset"),
        F.nullif(F.regexp_extract(F.lower(name), r"(mbo|mbp-\d+|trades|ohlcv|parquet|csv|json)", 1), F.lit("")).alias("schema"),
    )


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        digests = []
        for path in pdf["path"]:
            filesystem, inner = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with filesystem.open_input_stream(inner) as stream:
                while block := stream.read(_CHUNK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pdf.assign(file_hash=digests)


def with_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of every file, streamed in blocks inside the tasks (any file size)."""
    schema = files.schema.add("file_hash", "string")
    return files.repartition("path").mapInPandas(_hash_files, schema)


def duplicates(files: DataFrame) -> DataFrame:
    """Files of equal content; the largest, then first by path, is kept.

    Only files that share a size are read for hashing.
    """
    shared = files.groupBy("size").count().filter(F.col("count") > 1).drop("count")
    suspects = files.join(shared, "size")
    hashed = with_hashes(suspects) if "file_hash" not in files.columns else suspects
    return mark_duplicates(hashed, "file_hash")


def mark_duplicates(df: DataFrame, key: str, size: str = "size", name: str = "path") -> DataFrame:
    """is_duplicate and duplicate_of within rows of equal ``key``.

    The keeper of each key comes from a grouped aggregate, so a key shared by many
    rows is never sorted in one task.
    """
    keep = df.groupBy(key).agg(
        F.min_by(name, F.struct((-F.col(size)).alias("s"), F.col(name).alias("n"))).alias("_keep"),
        F.count(F.lit(1)).alias("_copies"),
    )
    joined = df.join(keep, key).filter(F.col("_copies") > 1)
    dup = F.col(name) != F.col("_keep")
    return joined.withColumns(
        {"is_duplicate": dup, "duplicate_of": F.when(dup, F.col("_keep"))}
    ).drop("_keep", "_copies")


def rollup(df: DataFrame, levels: list[str], size: str = "size") -> DataFrame:
    """Counts and bytes at every level of the hierarchy and in total."""
    return df.rollup(*levels).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("files"),
        F.sum(size).alias("bytes"),
        F.min(size).alias("smallest"),
        F.max(size).alias("largest"),
    )


def available_dates(df: DataFrame, column: str = "trade_date") -> DataFrame:
    return df.select(column).distinct().orderBy(F.desc(column))


def dates_in_names(files: DataFrame, pattern: str = r"(\d{8})_") -> DataFrame:
    """Dates found in file names, newest first."""
    d = F.regexp_extract("file_name", pattern, 1)
    return files.select(d.alias("date")).filter("date <> ''").distinct().orderBy(F.desc("date"))


def catalogue(df: DataFrame, by: list[str]) -> DataFrame:
    """Per data type: number of dates, first, last, rows."""
    return df.groupBy(*by).agg(
        F.count_distinct("trade_date").alias("dates"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.count(F.lit(1)).alias("events"),
    )
