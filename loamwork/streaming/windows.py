"""Windowed totals over events, the same for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, schema, late: str = "10 minutes") -> DataFrame:
    """Event files as a stream with a watermark. Event times without a zone are read in the session's."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def rate_stream(spark: SparkSession, rows_per_second: int, users: int = 100) -> DataFrame:
    """Made-up events at a steady rate, to try a stream with."""
    made = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    kinds = F.array(*map(F.lit, ("click", "view", "purchase")))
    return made.select(
        F.col("value").alias("event_id"), F.col("timestamp").alias("ts"), (F.col("value") % users).alias("user_id"), F.element_at(kinds, (F.col("value") % 3 + 1).cast("int")).alias("event_type"), F.lit(1.0).alias("value")
    ).withWatermark("ts", "10 minutes")


def windowed_totals(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events and their value by window and type."""
    window = F.window(F.col("ts").cast("timestamp") if not events.isStreaming else F.col("ts"), length, slide or length)
    totals = events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return totals.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def session_totals(events: DataFrame, gap: str) -> DataFrame:
    """Events and their value by user and session."""
    at = F.col("ts").cast("timestamp") if not events.isStreaming else F.col("ts")
    totals = events.groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return totals.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n", "total")
