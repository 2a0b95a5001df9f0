"""Search, detail and summary queries over the stored tables.

Every function returns a DataFrame; a page is ``.offset().limit()`` after a total
order, and totals are separate aggregates, so each can be planned by itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.functions import coerce
from fairlead.functions.dates import DATE, in_range
from fairlead.operators import hybrid, slices
from fairlead.operators.encounters import current_encounters, latest_reports, urgency
from fairlead.schema import RISK_LEVELS
from fairlead.session import cut_lineage

ACTIVE_MINUTES = 15
MOVING_KNOTS = 0.5
#: Looked-up reports (some 100 bytes each) up to which they are sent to all tasks, so that encounters stay where they are read.
SENT_REPORTS = 1_000_000


def page(ordered: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of a totally ordered result."""
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def total(filtered: DataFrame) -> DataFrame:
    return filtered.agg(F.count(F.lit(1)).alias("total"))


def check_bounds(start: datetime | None, end: datetime | None) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError("start_time must be earlier than or equal to end_time.")


def between(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    check_bounds(start, end)
    return in_range(df, "timestamp", start, end)


def within_watermark(df: DataFrame, messages: DataFrame, column: str, minutes: int = ACTIVE_MINUTES) -> DataFrame:
    """Rows of the active window, measured back from the newest report of all.

    The two bounds are scalar subqueries, so they reach the scan as constants.
    ``messages`` may be the latest state per vessel: the newest report is the same.
    """
    newest = messages.agg(F.max("timestamp"))
    cutoff = messages.agg(F.max("timestamp") - F.expr(f"interval {int(minutes)} minutes"))
    return in_range(df, column, cutoff.scalar(), newest.scalar())


# --- vessels and positions ---------------------------------------------------


def matching_vessels(vessels: DataFrame, text: str | None = None) -> DataFrame:
    if text is None:
        return vessels
    pattern = f"%{text.strip()}%"
    hit = F.lit(False)
    for c in ("mmsi", "vessel_name", "imo", "call_sign"):
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return vessels.filter(hit)


def vessel_search(vessels: DataFrame, text: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    found = matching_vessels(vessels, text)
    return page(found.orderBy(F.col("vessel_name").asc_nulls_last(), "mmsi"), limit, offset)


def with_names(rows: DataFrame, vessels: DataFrame) -> DataFrame:
    """Add name and type of the vessel. One vessel row per key; sizes decide the join."""
    return rows.join(vessels.select("mmsi", "vessel_name", "vessel_type"), "mmsi")


def current_positions(messages: DataFrame, vessels: DataFrame) -> DataFrame:
    return with_names(latest_reports(messages), vessels)


def position_search(positions: DataFrame, text: str) -> DataFrame:
    query = text.strip().lower()
    if not query:
        return positions
    named = F.coalesce(F.lower("vessel_name").contains(query), F.lit(False))
    return positions.filter(F.col("mmsi").contains(query) | named)


def recent_positions(
    messages: DataFrame,
    vessels: DataFrame,
    limit: int = 500,
    active_only: bool = False,
    active_minutes: int = ACTIVE_MINUTES,
    not_before: datetime | None = None,
) -> DataFrame:
    """Newest report per vessel, newest first; ``not_before`` is the caller's clock cut-off."""
    latest = latest_reports(messages)
    if active_only:
        latest = within_watermark(latest, messages, "timestamp", active_minutes)
    if not_before is not None:
        latest = latest.filter(F.col("timestamp") >= coerce.utc(not_before))
    return with_names(latest, vessels).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def active_vessels(messages: DataFrame, minutes: int = ACTIVE_MINUTES) -> DataFrame:
    return within_watermark(latest_reports(messages), messages, "timestamp", minutes)


def moving_count(positions: DataFrame) -> DataFrame:
    return positions.agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(F.col("sog") >= MOVING_KNOTS).alias("moving")
    )


def vessel_detail(vessels: DataFrame, messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """All vessels with message count, alert count and newest position."""
    newest = latest_reports(messages).select(
        "mmsi", *[F.col(c).alias(f"latest_{c}") for c in ("id", "timestamp", "latitude", "longitude", "sog", "cog", "heading")]
    )
    counted = lambda df, name: df.groupBy("mmsi").agg(F.count(F.lit(1)).alias(name))
    joined = (
        vessels.join(counted(messages, "message_count"), "mmsi", "left")
        .join(counted(alerts, "alert_count"), "mmsi", "left")
        .join(newest, "mmsi", "left")
    )
    return joined.fillna(0, ["message_count", "alert_count"])


def known_vessel(vessels: DataFrame, mmsi: str) -> None:
    if vessels.filter(F.col("mmsi") == mmsi).isEmpty():
        raise LookupError(f"Vessel {mmsi} was not found.")


def line_or_point(points: Column) -> Column:
    """GeoJSON-like geometry of an ordered point list: a Point when there is just one."""
    pair = lambda p: F.array(p["longitude"], p["latitude"])
    coordinates = F.transform(points, pair)
    return F.struct(
        F.when(F.size(points) == 1, "Point").otherwise("LineString").alias("type"), coordinates.alias("coordinates")
    )


def trajectory_points(
    messages: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
    mmsi: str | None = None,
) -> DataFrame:
    """The points of every vessel in time order, with their position number.

    ``limit`` is the page size of a request for one vessel; without it tracks are whole.
    """
    chosen = between(messages, start, end)
    if mmsi is not None:
        chosen = chosen.filter(F.col("mmsi") == mmsi)
    numbered = slices.with_position(chosen, "point", tie="id")
    return numbered if limit is None else numbered.filter(F.col("point") <= limit)


def vessel_trajectories(points: DataFrame) -> DataFrame:
    """One row per vessel with its line; the points were limited per vessel before."""
    pack = F.struct("point", "timestamp", "id", "longitude", "latitude")
    tracks = points.groupBy("mmsi").agg(F.array_sort(F.collect_list(pack)).alias("points"))
    return tracks.select(
        "mmsi",
        F.size("points").alias("point_count"),
        F.element_at("points", 1)["timestamp"].alias("start_time"),
        F.element_at("points", -1)["timestamp"].alias("end_time"),
        line_or_point(F.col("points")).alias("geometry"),
        "points",
    )


def clip_trajectory(tracks: DataFrame, at: datetime) -> DataFrame:
    """Tracks without anything later than ``at``; all derived fields are recomputed."""
    kept = F.filter("points", lambda p: p["timestamp"] <= coerce.utc(at))
    return tracks.select("mmsi", kept.alias("points")).select(
        "mmsi",
        F.size("points").alias("point_count"),
        F.get("points", F.lit(0))["timestamp"].alias("start_time"),
        F.get("points", F.size("points") - 1)["timestamp"].alias("end_time"),
        line_or_point(F.col("points")).alias("geometry"),
        "points",
    )


# --- alerts and risks -----------------------------------------------------------


def anomaly_search(
    alerts: DataFrame,
    messages: DataFrame,
    mmsi: str | None = None,
    severity: str | None = None,
    anomaly_type: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    current_only: bool = False,
    active_minutes: int = ACTIVE_MINUTES,
) -> DataFrame:
    """Alerts that pass all given filters. Alerts carry vessel, place and message id."""
    found = between(alerts, start, end)
    for column, wanted in (("mmsi", mmsi), ("severity", severity), ("anomaly_type", anomaly_type)):
        if wanted is not None:
            found = found.filter(F.col(column) == wanted)
    return within_watermark(found, messages, "timestamp", active_minutes) if current_only else found


def newest_alerts_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("timestamp"), F.desc("message_id"), F.desc("anomaly_type"))


def anomaly_types(alerts: DataFrame) -> DataFrame:
    """Sorted alert types per vessel; a set of at most seven names."""
    return alerts.groupBy("mmsi").agg(F.array_sort(F.collect_set("anomaly_type")).alias("anomaly_types"))


def risk_search(
    risks: DataFrame,
    messages: DataFrame,
    mmsi: str | None = None,
    level: str | None = None,
    minimum_percentile: float | None = None,
    agreement: bool | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    current_only: bool = False,
    active_minutes: int = ACTIVE_MINUTES,
) -> DataFrame:
    found = between(risks, start, end)
    for column, wanted in (("mmsi", mmsi), ("risk_level", level), ("detector_agreement", agreement)):
        if wanted is not None:
            found = found.filter(F.col(column) == wanted)
    if minimum_percentile is not None:
        found = found.filter(F.col("ml_anomaly_percentile") >= minimum_percentile)
    return within_watermark(found, messages, "timestamp", active_minutes) if current_only else found


def gravest_first(found: DataFrame) -> DataFrame:
    return found.orderBy(
        hybrid.level_rank(F.col("risk_level")).desc(),
        F.desc("ml_anomaly_percentile"),
        F.desc("timestamp"),
        F.desc("message_id"),
    )


def vessel_risk(risks: DataFrame, messages: DataFrame, vessels: DataFrame, mmsi: str, **filters) -> DataFrame:
    known_vessel(vessels, mmsi)
    return risk_search(risks, messages, mmsi=mmsi, **filters)


def vessel_pages(risks: DataFrame, limit: int) -> DataFrame:
    """The first page of every vessel at once, with the place on it.

    The page size bounds what leaves a map task per vessel.
    """
    gravest = Window.partitionBy("mmsi").orderBy(
        hybrid.level_rank(F.col("risk_level")).desc(), F.desc("ml_anomaly_percentile"), F.desc("timestamp"), F.desc("message_id")
    )
    return risks.withColumn("place", F.row_number().over(gravest)).filter(F.col("place") <= limit)


def risk_summary(risks: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return risks.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(level == name).alias(name) for name in RISK_LEVELS],
        F.count_if(level != "low").alias("elevated"),
        F.count_if(F.col("detector_agreement")).alias("detector_agreement"),
    )


# --- encounters and state ---------------------------------------------------------


def encounter_details(encounters: DataFrame, messages: DataFrame, vessels: DataFrame) -> DataFrame:
    """Both sides' names and motion for every encounter.

    The reports that encounters name are few beside the pairs: they are looked up
    first and stored, so that every pair meets one small table per side. Up to
    ``SENT_REPORTS`` of them are sent to all tasks, whatever Spark takes their size
    for; beyond that pairs are shuffled. Give ``encounters`` as a stored table, it is
    read for its reports and for its pairs.
    """
    dated = DATE in messages.columns  # lets the encounters' dates select the partitions read
    day = [DATE] if dated else []
    reports = lambda side: encounters.select(
        F.col(f"mmsi_{side}").alias("mmsi"),
        F.col(f"message_{side}").alias("message"),
        *([F.to_date(f"observed_at_{side}").alias(DATE)] if dated else []),
    )
    state = messages.select(F.col("id").alias("message"), "latitude", "longitude", "sog", "cog", *day)
    names = vessels.select("mmsi", F.col("vessel_name").alias("name"))
    named = reports("a").unionByName(reports("b")).distinct()
    states = cut_lineage(named.join(state, ["message", *day]).join(names, "mmsi"))
    few = states.count() <= SENT_REPORTS
    detailed = encounters
    for side in ("a", "b"):
        if dated:
            detailed = detailed.withColumn(f"{DATE}_{side}", F.to_date(f"observed_at_{side}"))
        own = states.select([F.col(c).alias(f"{c}_{side}") for c in states.columns])
        keys = [f"{c}_{side}" for c in ("mmsi", "message", *day)]
        detailed = detailed.join(F.broadcast(own) if few else own, keys).drop(f"{DATE}_{side}")
    return detailed


def collision_search(
    encounters: DataFrame,
    latest: DataFrame,
    level: str | None = None,
    minimum_tcpa: float | None = None,
    maximum_tcpa: float | None = None,
    current_only: bool = False,
) -> DataFrame:
    found = encounters
    if level is not None:
        found = found.filter(F.col("risk_level") == level)
    if minimum_tcpa is not None:
        found = found.filter(F.col("tcpa_minutes") >= minimum_tcpa)
    if maximum_tcpa is not None:
        found = found.filter(F.col("tcpa_minutes") <= maximum_tcpa)
    return current_encounters(found, latest) if current_only else found


def most_urgent_first(found: DataFrame) -> DataFrame:
    return found.orderBy(
        urgency(F.col("risk_level")),
        F.col("tcpa_minutes").asc_nulls_last(),
        "cpa_distance_nm",
        F.desc("observed_at"),
        "message_a",
        "message_b",
    )


def collision_summary(encounters: DataFrame) -> DataFrame:
    return encounters.agg(
        F.count_if(F.col("risk_level").isin(*RISK_LEVELS)).alias("total"),
        *[F.count_if(F.col("risk_level") == name).alias(name) for name in RISK_LEVELS],
    )


def live_status(vessels: DataFrame, messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts, newest report and newest import job: one row."""
    stored = messages.agg(F.count(F.lit(1)).alias("message_count"), F.max("timestamp").alias("latest_timestamp"))
    known = vessels.agg(F.count(F.lit(1)).alias("vessel_count"))
    newest_job = jobs.agg(
        F.max_by(F.struct("job_id", "source_file", "status"), F.struct("started_at", "job_id")).alias("latest_import")
    )
    return (
        stored.crossJoin(known)
        .crossJoin(newest_job)
        .withColumn(
            "ingestion_active", F.coalesce(F.col("latest_import.status").isin("pending", "running"), F.lit(False))
        )
    )


def incident_timeline(risks: DataFrame, alerts: DataFrame, show: str = "all") -> DataFrame:
    """One row per vessel and time: its assessment and what alerts coincide with it.

    Of several assessments the first (smallest message id) counts. Alerts are
    kept as count, sorted types (at most seven) and gravest severity;
    ``timeline_alerts`` lists them one by one.
    """
    if show not in ("all", "risk", "anomaly"):
        raise ValueError("show must be all, risk or anomaly")
    risk = F.struct("message_id", "risk_level", "ml_anomaly_percentile", "rule_flag_count", "risk_reasons")
    by_risk = risks.groupBy("mmsi", "timestamp").agg(F.min_by(risk, "message_id").alias("risk"))
    gravity = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).otherwise(1)
    by_alert = alerts.groupBy("mmsi", "timestamp").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.array_sort(F.collect_set("anomaly_type")).alias("alert_types"),
        F.max_by("severity", gravity).alias("gravest_severity"),
    )
    joined = by_risk.join(by_alert, ["mmsi", "timestamp"], "full_outer").fillna(0, ["alert_count"])
    joined = joined.withColumn("correlated", F.col("risk").isNotNull() & (F.col("alert_count") > 0))
    if show == "risk":
        return joined.filter(F.col("risk").isNotNull())
    return joined.filter(F.col("alert_count") > 0) if show == "anomaly" else joined


def timeline_alerts(risks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every alert with the first assessment of the same vessel and time, if any."""
    first = risks.groupBy("mmsi", "timestamp").agg(F.min("message_id").alias("risk_message_id"))
    return alerts.join(first, ["mmsi", "timestamp"], "left")


def correlated_count(timeline: DataFrame) -> DataFrame:
    return timeline.agg(F.count(F.lit(1)).alias("incidents"), F.count_if("correlated").alias("correlated"))
