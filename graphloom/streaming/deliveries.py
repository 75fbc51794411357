"""Streaming forms of the event metrics: windows with watermarks over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_a_batch: int = 16) -> DataFrame:
    """Events from parquet files as they arrive in ``folder``, with ``at`` as event time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(``start``, ``event_type``, ``n``, ``total``) a window; events later than ``late`` are left out."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, window: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(``start``, ``n``) of every sliding window."""
    return events.withWatermark("at", late).groupBy(F.window("at", window, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(``user_id``, ``start``, ``end``, ``n``): runs of a user's events without a longer ``gap``."""
    own = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, write it as parquet and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
