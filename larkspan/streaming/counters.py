"""Time-keyed counters and a debounce, as batch windows and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped_calls(events: DataFrame, day_cap: int, month_cap: int = 0) -> DataFrame:
    """(day, calls, admitted): calls of a user are admitted while the calendar day's and the month's counts stay below their caps; a cap of 0 or less switches its window off.

    Only calls that the day admits count against the month.
    """
    rows = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("month", F.date_format("ts", "yyyy-MM"))
    good = F.lit(True)
    for period, cap in (("day", day_cap), ("month", month_cap)):
        if cap > 0:
            counted = F.sum(good.cast("int")).over(Window.partitionBy("user_id", period).orderBy("ts", "event_id"))
            rows = rows.withColumn(f"_{period}", good & (counted <= cap))
            good = F.col(f"_{period}")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("calls"), F.count_if(good).alias("admitted"))


def debounced(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Per user the last event of each burst: no other follows within the gap."""
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("_next", after).where(F.col("_next").isNull() | (F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > gap_seconds * 1_000_000)).drop("_next")


def stream_daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls per day and event type of a stream, with a watermark for late rows."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("calls"))


def stream_bursts(stream: DataFrame, gap: str = "500 milliseconds", late: str = "1 day") -> DataFrame:
    """Bursts of a user by session windows, with the last event of each."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event_id"), F.count(F.lit(1)).alias("events"))


def as_of_state(events: DataFrame, success: str, failure: str, ask: str, fresh_seconds: int, kept_seconds: int, cooldown_seconds: int) -> DataFrame:
    """Each ``ask`` event with its user's table state and whether it may fetch.

    ``state``: current, stale or frozen by the age of the last ``success``, missing if there was none.  ``fetches``: the
    table is not current, and no ``failure`` lies within the cooldown.
    """
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = lambda kind: F.last(F.when(F.col("event_type") == kind, F.col("ts")), ignorenulls=True).over(line)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = events.withColumn("_ok", last(success)).withColumn("_bad", last(failure)).where(F.col("event_type") == ask)
    age, pause = micros(F.col("ts")) - micros(F.col("_ok")), micros(F.col("ts")) - micros(F.col("_bad"))
    state = F.when(F.col("_ok").isNull(), "missing").when(age <= fresh_seconds * 1_000_000, "current").when(age <= kept_seconds * 1_000_000, "stale").otherwise("frozen")
    cool = F.coalesce(pause >= cooldown_seconds * 1_000_000, F.lit(True))
    return rows.withColumn("state", state).withColumn("fetches", (F.col("state") != "current") & cool).drop("_ok", "_bad")


def cached(events: DataFrame, key: list[str]) -> DataFrame:
    """Per composite key the event that computes the answer (the first) and how many later ones are served from it."""
    return events.groupBy(*key).agg(F.min("event_id").alias("computed_by"), (F.count(F.lit(1)) - 1).alias("served_again"))
