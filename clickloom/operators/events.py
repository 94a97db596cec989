"""The event log: platform names, the half-open window, the enriched frame that every family reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.kernels import by_time, derive, seconds  # noqa: F401

#: Visitors' windows are broadcast below so many rows; a larger table is joined by shuffle.
MOST_BROADCAST = 1_000_000


def normalise_platform(events: DataFrame) -> DataFrame:
    low = F.lower("platform")
    return events.withColumn("platform", F.when(low == "iphone", "ios").otherwise(low))


def clip_to_window(events: DataFrame, cookies: DataFrame, small: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of known visitors with start <= ts < end, with the visitor's ``keep`` columns.

    The visitors' number is counted unless it is given.
    """
    bounds = cookies.select("cookie_id", "window_start_ts", "window_end_ts", *keep)
    small = bounds.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST if small is None else small
    inside = (F.col("event_ts") >= F.col("window_start_ts")) & (F.col("event_ts") < F.col("window_end_ts"))
    return events.join(F.broadcast(bounds) if small else bounds, "cookie_id").where(inside).drop("window_start_ts", "window_end_ts")


def assert_no_leak(events: DataFrame, cookies: DataFrame) -> None:
    bounds = cookies.select("cookie_id", "window_start_ts", "window_end_ts")
    bad = events.join(bounds, "cookie_id").where("NOT (event_ts >= window_start_ts AND event_ts < window_end_ts)").limit(1).collect()
    if bad:
        raise ValueError(f"an event lies outside its visitor's window: {bad[0]}")


def window_profile(events: DataFrame, cookies: DataFrame) -> DataFrame:
    """Shares of events before and after the window; after means ts > end, as the profile has always been read."""
    rows = events.join(cookies.select("cookie_id", "window_start_ts", "window_end_ts"), "cookie_id")
    return rows.agg(
        F.count("*").alias("n_events"),
        F.avg(F.expr("double(event_ts < window_start_ts)")).alias("early_share"),
        F.avg(F.expr("double(event_ts > window_end_ts)")).alias("late_share"),
        F.avg(F.expr("double(event_ts >= window_start_ts AND event_ts < window_end_ts)")).alias("kept_share"),
    )


def enrich(events: DataFrame, settings: Settings) -> DataFrame:
    """Time-ordered facts of each event: one exchange by visitor that all families share.

    sec, dt (gap to the event before), dt_before (that gap's predecessor), dt_third, dwell (gap to the next), prev_name,
    bucket (floor of log1p of the gap), sess (number of the session).
    """
    w = by_time()
    out = events.withColumn("sec", seconds(events, "event_ts"))
    out = out.withColumn("dt", F.col("sec") - F.lag("sec").over(w)).withColumn("dwell", F.lead("sec").over(w) - F.col("sec")).withColumn("prev_name", F.lag("event_name").over(w))
    out = out.withColumn("dt_before", F.lag("dt").over(w)).withColumn("dt_third", F.lag("dt", 2).over(w)).withColumn("bucket", F.floor(F.log1p("dt")))
    started = F.when(F.col("dt").isNull() | (F.col("dt") > settings.session_gap), 1).otherwise(0)
    return out.withColumn("sess", F.sum(started).over(w.rowsBetween(-(2**63), 0)))
