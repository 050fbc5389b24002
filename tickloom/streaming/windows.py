"""Event-time windows over streams, with a watermark policy for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import signed_size


def stream_bars(df: DataFrame, rule: str, late: str, key: str = "instrument", time: str = "event_time") -> DataFrame:
    """Footprint bars per tumbling window; rows later than ``late`` are dropped."""
    at = F.struct(time, "sequence") if "sequence" in df.columns else F.col(time)
    bars = (
        df.withWatermark(time, late)
        .groupBy(key, F.window(time, rule).alias("_w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.sum(signed_size()).alias("delta"),
        )
    )
    return bars.select(key, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "delta")


def stream_sliding(df: DataFrame, size: str, slide: str, late: str, key: str = "instrument", time: str = "event_time") -> DataFrame:
    """Volume, delta and counts per sliding window."""
    return (
        df.withWatermark(time, late)
        .groupBy(key, F.window(time, size, slide).alias("_w"))
        .agg(F.sum("size").alias("volume"), F.sum(signed_size()).alias("delta"), F.count(F.lit(1)).alias("events"))
        .select(key, F.col("_w.start").alias("window_start"), "volume", "delta", "events")
    )


def stream_sessions(df: DataFrame, gap: str, late: str, key: str = "instrument", time: str = "event_time") -> DataFrame:
    """Activity sessions closed by a gap."""
    return (
        df.withWatermark(time, late)
        .groupBy(key, F.session_window(time, gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("volume"))
        .select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "events", "volume")
    )


def latest_quotes(df: DataFrame, key: str = "instrument", time: str = "event_time") -> DataFrame:
    """Newest price, size and side per key (update mode)."""
    at = F.struct(time, "sequence") if "sequence" in df.columns else F.col(time)
    return df.groupBy(key).agg(
        F.max_by("price", at).alias("last_price"), F.max_by("size", at).alias("last_size"),
        F.max_by("side", at).alias("last_side"), F.max(time).alias("last_time"), F.count(F.lit(1)).alias("rows"),
    )


def split_late(batch: DataFrame, bound: object, time: str = "event_time") -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch against the newest time already closed."""
    if bound is None:
        return batch, batch.limit(0)
    late = F.col(time) < F.lit(bound)
    return batch.filter(~late), batch.filter(late)


class LateRouter:
    """foreachBatch writer that stores rows older than the allowed lateness apart.

    The newest time seen is kept in a small file-backed table next to the output, so a
    restarted query goes on with the same bound.
    """

    def __init__(self, path: str, late_seconds: int, time: str = "event_time"):
        self.path, self.late_seconds, self.time = path, late_seconds, time

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            bound = spark.read.parquet(f"{self.path}/clock").filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            bound = None
        if bound is not None:
            bound = spark.range(1).select((F.lit(bound) - F.expr(f"INTERVAL {self.late_seconds} SECONDS")).alias("b")).first()[0]
        on_time, late = split_late(batch, bound, self.time)
        for name, part in (("on_time", on_time), ("late", late)):
            # one folder per batch: a retried batch replaces its own output
            part.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        batch.agg(F.lit(batch_id).alias("batch"), F.max(self.time).alias("newest")).write.mode("overwrite").parquet(
            f"{self.path}/clock/part={batch_id}"
        )
        batch.unpersist()


def bar_parts(df: DataFrame, rule: str, key: str = "instrument", time: str = "event_time") -> DataFrame:
    """Mergeable state of the bars of some rows: a bar cut by a micro-batch has a part in each."""
    at = F.struct(time, "sequence", "price")
    parts = df.groupBy(key, F.window(time, rule).alias("_w")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("size").alias("volume")
    )
    return parts.select(key, F.col("_w.start").alias("bar_start"), "first", "last", "high", "low", "volume")


def merged_bars(parts: DataFrame, key: str = "instrument") -> DataFrame:
    """Whole bars from the parts of all micro-batches."""
    return parts.groupBy(key, "bar_start").agg(
        F.min("first")["price"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last")["price"].alias("close"), F.sum("volume").alias("volume"),
    )


def per_batch(df: DataFrame, fn, path: str, checkpoint: str):
    """Run a batch operator on every micro-batch and append its result, one folder a batch.

    The operator must give parts that can be merged on reading, such as ``bar_parts``.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RecentRows:
    """foreachBatch writer that keeps the newest ``n`` rows of each key.

    Every batch writes a folder with the whole buffer: that of the batch before, the new
    rows, cut to ``n`` a key. A retried batch overwrites its own folder.
    """

    def __init__(self, path: str, n: int, keys: list[str], order: list[str]):
        self.path, self.n, self.keys, self.order = path, n, keys, order

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(self._folder(batch_id - 1)).unionByName(batch)
        newest = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order])
        kept = rows.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= self.n).drop("_place")
        kept.write.mode("overwrite").parquet(self._folder(batch_id))

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id}"

    def run(self, df: DataFrame) -> DataFrame:
        """Read what is there and return the buffer."""
        q = df.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/_cp").trigger(availableNow=True).start()
        q.awaitTermination()
        last = q.lastProgress
        return df.sparkSession.read.schema(df.schema).parquet(self._folder(last["batchId"])) if last else df.sparkSession.createDataFrame([], df.schema)


class FirstRows:
    """foreachBatch writer that takes exactly the first ``n`` rows of a stream and then ends it.

    Rows of a batch are taken in ``order``; batches in the order of arrival.
    """

    def __init__(self, path: str, n: int, order: list[str]):
        self.path, self.n, self.order, self.taken = path, n, order, 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rest = self.n - self.taken
        if rest > 0:
            folder = f"{self.path}/batch={batch_id}"
            batch.orderBy(*self.order).limit(rest).write.mode("overwrite").parquet(folder)
            self.taken += batch.sparkSession.read.schema(batch.schema).parquet(folder).count()

    def run(self, df: DataFrame) -> DataFrame:
        q = df.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/_cp").start()
        while q.isActive and self.taken < self.n and not (q.lastProgress and not q.lastProgress["numInputRows"]):
            q.awaitTermination(0.2)
        if q.exception():
            raise q.exception()
        q.stop()
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/batch=*")
