"""Historical views: the densest day, snapshots at a time, frames, event windows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from fairlead.functions import coerce
from fairlead.functions.dates import in_range
from fairlead.operators.encounters import latest_reports

TOLERANCE_MINUTES = 5.0
EVENT_MINUTES = 15


def reference_day(messages: DataFrame) -> DataFrame:
    """The UTC day with the most reports, the earlier one on a tie: one row or none."""
    return (
        messages.groupBy(F.date_trunc("day", "timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("observations"))
        .orderBy(F.desc("observations"), "day")
        .limit(1)
    )


def on_reference_day(messages: DataFrame) -> DataFrame:
    """Reports of the densest day.

    The day is one value, so it is fetched and put into the filter, where it can
    prune partitions and reach the Parquet scan.
    """
    best = reference_day(messages).select(F.unix_micros("day").alias("micros")).first()
    if best is None:
        return messages.limit(0)
    start, end = (F.timestamp_micros(F.lit(best.micros + offset)) for offset in (0, 86_400_000_000 - 1))
    return in_range(messages, "timestamp", start, end)


def playback_bounds(messages: DataFrame) -> DataFrame:
    return on_reference_day(messages).agg(
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.count(F.lit(1)).alias("observation_count"),
        F.count_distinct("mmsi").alias("vessel_count"),
    )


def playback_snapshot(messages: DataFrame, at: datetime, tolerance_minutes: float = TOLERANCE_MINUTES) -> DataFrame:
    """Newest report of every vessel in the closed interval [at - tolerance, at]."""
    earliest = at - timedelta(minutes=tolerance_minutes)
    return latest_reports(in_range(messages, "timestamp", earliest, at))


def playback_frames(
    messages: DataFrame,
    start: datetime,
    end: datetime,
    step_seconds: float = 60.0,
    tolerance_minutes: float = TOLERANCE_MINUTES,
) -> DataFrame:
    """A snapshot at every step from start to end, as one job.

    Each report names the few frames it can serve ([its time, + tolerance]), so
    the as-of match is a top-1 per (frame, vessel) without any range join.
    """
    step, reach = int(step_seconds * 1_000_000), int(tolerance_minutes * 60_000_000)
    begin = F.lit(coerce.utc_micros(start))
    last = F.lit((coerce.utc_micros(end) - coerce.utc_micros(start)) // step)
    since = F.unix_micros("timestamp") - begin
    first_frame = F.greatest(F.ceil(since / step), F.lit(0))
    final_frame = F.least(F.floor((since + reach) / step), last)
    usable = in_range(messages, "timestamp", start - timedelta(minutes=tolerance_minutes), end)
    served = (
        usable.withColumn("_first", first_frame.cast("bigint"))
        .withColumn("_final", final_frame.cast("bigint"))
        .filter("_first <= _final")
        .withColumn("frame", F.explode(F.sequence("_first", "_final")))
        .drop("_first", "_final")
        .withColumn("frame_time", F.timestamp_micros(begin + F.col("frame") * step))
    )
    newest = Window.partitionBy("frame", "mmsi").orderBy(F.desc("timestamp"), F.desc("id"))
    return served.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def playback_events(events: DataFrame, at: datetime, column: str = "timestamp", minutes: int = EVENT_MINUTES) -> DataFrame:
    """Events of the closed interval [at - minutes, at]."""
    return in_range(events, column, at - timedelta(minutes=minutes), at)
