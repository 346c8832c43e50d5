"""Streams: new documents through the same transforms, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_windows(events: DataFrame, length: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(start, event_type, n, total): events and their values by window and type; later ones than `late` are left out. A stream that
    has a watermark already keeps it with late = None."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer pause than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unseen(rows: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the time that late rows may take."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there, writes it as Parquet and ends; a later call goes on where this one stopped."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def grow(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str) -> None:
    """Applies a batch transform to each arrival and appends rows whose key the target doesn't have yet."""

    def arrived(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = transform(batch)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            made = made.join(spark.read.parquet(target).select(key), key, "left_anti")
        made.dropDuplicates([key]).write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
