"""Event streams in windows: an extension, with the batch plan of the same aggregation beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows; on a stream, events later than the watermark are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)
