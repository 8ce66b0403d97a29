"""The time-bucket rollups over streams: the same measures, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions import exprs as X

EVENT_SCHEMA = "event_id long, tenant_id long, user_id long, value double, created_at timestamp"


def read_events(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def window_rollup(events: DataFrame, every: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """tenant_id, window_start, events_count, total_value by tumbling or sliding windows; rows later than `late` are left out."""
    window = F.window("created_at", every, slide) if slide else F.window("created_at", every)
    grouped = events.withWatermark("created_at", late).groupBy("tenant_id", window.alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events_count"), X.exact_sum(F.col("value")).alias("total_value")).select("tenant_id", F.col("w.start").alias("window_start"), "events_count", "total_value")


def session_rollup(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of a user: events no more than `gap` apart."""
    grouped = events.withWatermark("created_at", late).groupBy("user_id", F.session_window("created_at", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events_count")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events_count")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])


def write_rollup(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows as Parquet until the stream's present end; restarting with the checkpoint repeats nothing."""
    return rollup.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
