"""Stream sources and sinks: JSON ticks from files or Kafka, bounded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

TICK_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("side", T.StringType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("bid_size", T.DoubleType()),
        T.StructField("ask_size", T.DoubleType()),
    ]
)


def parsed_ticks(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages to ticks with the message defaults and an event-time column."""
    m = F.from_json(F.col(column).cast("string"), TICK_SCHEMA)
    d = raw.select(m.alias("m")).select("m.*")
    return d.withColumns(
        {
            "price": F.coalesce("price", F.lit(0.0)),
            "size": F.coalesce("size", F.lit(1.0)),
            "side": F.coalesce("side", F.lit("buy")),
            "event_time": F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long")),
        }
    )


def json_tick_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Newline-delimited JSON messages appearing in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parsed_ticks(reader.load(path))


def json_tick_topic(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int | None = None) -> DataFrame:
    """JSON messages of a Kafka topic (needs the Kafka connector on the classpath)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return parsed_ticks(reader.load())


def event_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet event files appearing in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: str | None = None) -> StreamingQuery:
    """Append to files; ``trigger`` None processes what is available and stops."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def run_to_table(df: DataFrame, path: str, output_mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Run over the available input and return what was written.

    ``partitions`` of the state, if fewer than the session's shuffle partitions: every one of
    them opens its store and its Python workers in every trigger, with or without rows.

    Update-mode results keep the newest row per batch in ``batch_id``: every batch has a
    folder of its own that a retry overwrites, so no row is written twice.
    """
    spark = df.sparkSession
    checkpoint = f"{path}/_checkpoint"
    if output_mode == "append":
        shuffle = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(min(partitions or int(shuffle), int(shuffle))))
        try:  # a query takes the settings of its start
            running = to_files(df, f"{path}/data", checkpoint)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        running.awaitTermination()
    else:

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

        q = df.writeStream.outputMode(output_mode).foreachBatch(save).option("checkpointLocation", checkpoint)
        q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/data")


def with_status(df: DataFrame, name: str = "status", order: tuple[str, ...] = ("event_time",)) -> DataFrame:
    """Attach counters (rows, price of the newest row, newest time) that each trigger reports."""
    return df.observe(
        name, F.count(F.lit(1)).alias("rows"), F.max_by("price", F.struct(*order)).alias("last_price"), F.max(order[0]).alias("last_time")
    )


def status(query: StreamingQuery, name: str = "status") -> dict:
    """Totals of the counters of ``with_status`` over the triggers the query still remembers.

    Keys: batches, rows, last_price, last_time (of the trigger with the newest time).
    """
    seen = [p["observedMetrics"][name] for p in query.recentProgress if name in (p["observedMetrics"] or {})]
    newest = max((m for m in seen if m["last_time"] is not None), key=lambda m: str(m["last_time"]), default=None)
    return {
        "batches": sum(m["rows"] > 0 for m in seen), "rows": sum(m["rows"] for m in seen),
        "last_price": newest and newest["last_price"], "last_time": newest and newest["last_time"],
    }
