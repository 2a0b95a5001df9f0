"""Per-vessel motion features from consecutive reports.

Three published variants differ in small points, so one builder takes them as
options. Features are computed for all vessels at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.functions import coerce, geo
from fairlead.operators import slices
from fairlead.operators.cleaning import range_null_features
from fairlead.schema import CORE, require_columns

_CARRY = ["timestamp", "latitude", "longitude", "sog", "cog", "heading"]


@dataclass(frozen=True)
class MotionOptions:
    """Where the variants differ.

    mask_distance: no distance and no turn where no time has passed
    absolute_difference: speed difference without its sign
    tie: column that orders reports with equal times
    """

    mask_distance: bool = False
    absolute_difference: bool = True
    tie: str = "ord"
    slice_seconds: int = slices.SIX_HOURS


def _typed(df: DataFrame) -> DataFrame:
    measures = {c: coerce.number(df, c) for c in ("latitude", "longitude", "sog", "cog", "heading")}
    return df.withColumns(
        {**measures, "mmsi": coerce.mmsi_text(F.col("mmsi").cast("string")), "timestamp": coerce.instant(df, "timestamp")}
    )


def _seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def motion_features(df: DataFrame, options: MotionOptions = MotionOptions()) -> DataFrame:
    """Gaps, distances, speeds, turns and acceleration against the previous report."""
    return measure(slices.with_previous(_typed(df), _CARRY, tie=options.tie, seconds=options.slice_seconds), options)


def measure(linked: DataFrame, options: MotionOptions = MotionOptions()) -> DataFrame:
    """The features of reports that carry their predecessor in ``_prev``."""
    prev = F.col("_prev")
    here = F.col
    timed = linked.withColumn("elapsed_seconds", _seconds_between(here("timestamp"), prev["timestamp"]))
    moving_on = F.col("elapsed_seconds") > 0.0
    gap = F.col("elapsed_seconds") / 60.0
    distance = geo.haversine_nm(prev["latitude"], prev["longitude"], here("latitude"), here("longitude"))
    course = geo.angle_change(here("cog"), prev["cog"])
    heading = geo.angle_change(here("heading"), prev["heading"])
    if options.mask_distance:
        distance, course, heading = (F.when(moving_on, value) for value in (distance, course, heading))
    first = timed.withColumns(
        {
            "reporting_gap_minutes": gap,
            "nonpositive_time_interval": coerce.false_if_null(F.col("elapsed_seconds") <= 0.0),
            "distance_nm": distance,
            "course_change_degrees": course,
            "heading_change_degrees": heading,
            "sog_change_knots": here("sog") - prev["sog"],
        }
    )
    # The guards sit inside the divisor: ANSI division by zero raises.
    hours = F.when(moving_on, F.col("elapsed_seconds") / 3600.0)
    minutes = F.when(moving_on, F.col("reporting_gap_minutes"))
    second = first.withColumns(
        {
            "calculated_speed_knots": F.col("distance_nm") / hours,
            "acceleration_knots_per_minute": F.col("sog_change_knots") / minutes,
            "turn_rate_degrees_per_minute": F.col("course_change_degrees") / minutes,
        }
    )
    difference = F.col("calculated_speed_knots") - F.col("sog")
    return second.withColumns(
        {
            "speed_difference_knots": F.abs(difference) if options.absolute_difference else difference,
            "absolute_acceleration_knots_per_minute": F.abs(F.col("acceleration_knots_per_minute")),
        }
    )


def ais_features(df: DataFrame) -> DataFrame:
    """Model features: out-of-range values blanked first, distance kept at equal times."""
    require_columns(df, CORE + ("sog", "cog", "heading"), "AIS")
    return motion_features(range_null_features(_typed(df))).drop("_prev", "_slice")


def live_features(df: DataFrame) -> DataFrame:
    """Features for incremental analytics; equal times are ordered by message id."""
    require_columns(df, CORE + ("id", "sog", "cog", "heading"), "live context")
    return motion_features(df, MotionOptions(tie="id")).drop("_prev", "_slice")


def trajectory_metrics(df: DataFrame, tie: str = "ord") -> DataFrame:
    """Track metrics with previous values and distance along the track, for all vessels."""
    require_columns(df, CORE, "trajectory")
    usable = _typed(df).dropna(subset=list(CORE))
    options = MotionOptions(mask_distance=True, absolute_difference=False, tie=tie)
    measured = motion_features(usable, options)
    track = slices.with_running_sum(measured, "distance_nm", "cumulative_distance_nm", tie=tie)
    previous = {f"previous_{c}": F.col("_prev")[c] for c in ("timestamp", "latitude", "longitude", "cog", "heading")}
    return track.withColumns(previous).drop("_prev", "_slice")


def vessel_trajectory_metrics(df: DataFrame, mmsi: str | None = None, tie: str = "ord") -> DataFrame:
    """Track metrics of exactly one vessel; anything else is an error."""
    require_columns(df, CORE, "trajectory")
    one = df.withColumn("mmsi", coerce.mmsi_text(F.col("mmsi").cast("string")))
    if mmsi is not None:
        one = one.filter(F.col("mmsi") == str(mmsi))
        if one.isEmpty():
            raise ValueError(f"No AIS records found for MMSI {mmsi}.")
    # Two distinct values are enough to know; the count itself needs no full list.
    found = one.select("mmsi").filter("mmsi is not null").distinct().limit(2).count()
    if found != 1:
        raise ValueError(f"Trajectory metrics need exactly one MMSI, found {'none' if not found else 'several'}.")
    return trajectory_metrics(one, tie)


def trajectory_summary(metrics: DataFrame) -> DataFrame:
    """One row of track totals per vessel; plain partial aggregation."""
    return metrics.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("observations"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.coalesce(F.sum("distance_nm"), F.lit(0.0)).alias("total_distance_nm"),
        F.max("reporting_gap_minutes").alias("maximum_gap_minutes"),
        F.max("calculated_speed_knots").alias("maximum_calculated_speed_knots"),
        F.avg("sog").alias("average_sog_knots"),
        F.max("course_change_degrees").alias("maximum_course_change_degrees"),
    )


def busiest_vessel(df: DataFrame) -> DataFrame:
    """The vessel with the most reports; equal counts go to the smaller number."""
    return df.groupBy("mmsi").agg(F.count(F.lit(1)).alias("reports")).orderBy(F.desc("reports"), "mmsi").limit(1)
