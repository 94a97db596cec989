"""Structured Streaming forms of the session, bin and late-row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("event_time", F.col("event_ts").cast("timestamp")).withWatermark("event_time", late)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events, first and last time of each visitor's sessions, closed by the watermark."""
    return _timed(events, late).groupBy("cookie_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last")).select("cookie_id", "n", "first", "last")


def bin_counts(events: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each visitor in tumbling windows."""
    return _timed(events, late).groupBy("cookie_id", F.window("event_time", width).alias("w")).agg(F.count("*").alias("n")).select("cookie_id", F.col("w.start").alias("start"), "n")


def clip_stream(events: DataFrame, cookies: DataFrame) -> DataFrame:
    """A stream of events cut to its visitors' half-open windows; visitors are a static table."""
    bounds = cookies.select("cookie_id", "window_start_ts", "window_end_ts")
    return events.join(bounds, "cookie_id").where("event_ts >= window_start_ts AND event_ts < window_end_ts").drop("window_start_ts", "window_end_ts")
