"""User functions over batches and groups: the Python surface for what columns cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.fast import per_group
from tickloom.order import EventOrder, windowed


def process_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over Arrow batches of any size; it must not depend on where batches are cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def process_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over whole groups, each in the memory of one task. Where groups may outgrow a
    task, ``combine_groups`` gives the same for functions that can be merged."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def combine_groups(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    spread: int = 64,
) -> DataFrame:
    """An associative function over groups of any size.

    ``partial`` turns some rows of a group into few rows of ``schema`` (keys included);
    ``merge`` turns such rows into as few again and may be applied to its own results in
    any grouping. Groups are never whole in a task: batches are reduced where they are
    read, then in ``spread`` parts a group, then at last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, group in pdf.groupby(keys, dropna=False, sort=False):
                yield partial(group)

    part = F.pmod(F.spark_partition_id(), F.lit(spread))
    parts = df.mapInPandas(run, schema).groupBy(*keys, part.alias("_part")).applyInPandas(lambda pdf: merge(pdf), schema)
    return parts.groupBy(*keys).applyInPandas(lambda pdf: merge(pdf), schema)


def rolling_apply(df: DataFrame, order: EventOrder, column: str, n: int, fn: Callable[[pd.Series], float], out: str) -> DataFrame:
    """A user aggregate over the last n rows, NULL until n rows are there."""

    def solve(g: dict) -> dict:
        return {out: pd.Series(g[column].astype("float64")).rolling(n).apply(fn, raw=False).to_numpy()}

    return windowed(df, order, lambda d, f: per_group(d, f, {out: "double"}, solve, [column], n), before=n)


def training_shards(df: DataFrame, path: str, shards: int, key: str) -> None:
    """Write training rows as Parquet shards of about equal size, spread by key hash."""
    df.repartition(shards, F.xxhash64(key)).write.mode("overwrite").parquet(path)


def training_batches(df: DataFrame, size: int) -> Iterator[list]:
    """Stream rows to a trainer in batches, one partition in driver memory at a time."""
    batch: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
