"""Queries of search, summary, playback, replay and map features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fairlead.catalog import oracle_base as o
from fairlead.catalog.cleaning import ALERT_COLUMNS, ALERT_OUT
from fairlead.catalog.oracle_base import d, r, rs
from fairlead.catalog.priority import RANK, RISK_COLUMNS, RISK_OUT
from fairlead.catalog.registry import query
from fairlead.plans import playback, search
from fairlead.schema import RISK_LEVELS
from fairlead.sources import geojson, replay
from fairlead.catalog.collisions import _DETAILS

TO_VESSELS = (*o.TO_CLEAN, o.VESSELS)
TO_POSITIONS = (*o.TO_SNAP, o.VESSELS)
NEWEST = "(SELECT max(us) FROM clean)"
NOON = datetime(2024, 1, 1, 12)
NOON_US = o.ORIGIN + 43_200_000_000
POSITION = f"id, mmsi, vessel_name, us AS timestamp, {rs('latitude', 'longitude', 'sog')}"
POSITION_COLUMNS = ("id", "mmsi", "vessel_name", "timestamp", "latitude", "longitude", "sog")


@query(
    "vessel_search",
    o.sql("SELECT mmsi, vessel_name FROM vessels WHERE mmsi ILIKE '%1%' OR vessel_name ILIKE '%v1%' ORDER BY vessel_name NULLS LAST, mmsi LIMIT 50 OFFSET 10", *TO_VESSELS),
)
def _(w):
    return search.vessel_search(w.vessels(), " 1 ", 50, 10).select("mmsi", "vessel_name")


@query("vessel_search_total", o.sql("SELECT count(*) AS total FROM vessels WHERE mmsi ILIKE '%1%' OR vessel_name ILIKE '%1%'", *TO_VESSELS))
def _(w):
    return search.total(search.matching_vessels(w.vessels(), "1"))


@query(
    "position_search",
    o.sql(f"SELECT {POSITION} FROM latest JOIN (SELECT mmsi, vessel_name FROM vessels) USING (mmsi) WHERE contains(mmsi, 'v12') OR contains(lower(vessel_name), 'v12')",
          *(*o.TO_CLEAN, o.LATEST.replace("SELECT *, row", "SELECT * EXCLUDE (vessel_name), row"), o.VESSELS)),
)
def _(w):
    return search.position_search(_positions(w), " V12").select(*POSITION_COLUMNS)


def _positions(w):
    return search.current_positions(w.messages().drop("vessel_name", "vessel_type"), w.vessels())


@query(
    "vessel_detail",
    o.sql(
        f"""SELECT v.mmsi, v.vessel_name, v.first_seen, v.last_seen, coalesce(m.n, 0) AS message_count, coalesce(a.n, 0) AS alert_count,
        l.id AS latest_id, l.us AS latest_timestamp, {r('l.latitude', 'latest_latitude')}, {r('l.longitude', 'latest_longitude')}, {r('l.sog', 'latest_sog')}
        FROM vessels v LEFT JOIN (SELECT mmsi, count(*) n FROM clean GROUP BY 1) m USING (mmsi)
        LEFT JOIN (SELECT mmsi, count(*) n FROM alerts GROUP BY 1) a USING (mmsi) LEFT JOIN latest l USING (mmsi)""",
        *o.TO_ALERTS, o.VESSELS, o.LATEST,
    ),
)
def _(w):
    return search.vessel_detail(w.vessels(), w.messages(), w.alerts()).select(
        "mmsi", "vessel_name", "first_seen", "last_seen", "message_count", "alert_count", "latest_id", "latest_timestamp",
        "latest_latitude", "latest_longitude", "latest_sog",
    )


_POINTS = """
pts AS (
  SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY us, id) AS point FROM clean)"""
_LINE_END = "max_by({}, point)"


def _track_sql(source: str) -> str:
    return f"""SELECT mmsi, count(*) AS point_count, min(us) AS start_time, max(us) AS end_time,
        CASE WHEN count(*) = 1 THEN 'Point' ELSE 'LineString' END AS geometry_type,
        {r('min_by(longitude, point)', 'first_x')}, {r('max_by(latitude, point)', 'last_y')}, {r('sum(longitude)', 'sum_x')}
        FROM {source} GROUP BY mmsi"""


def _flat_track(tracks):
    first = F.get("geometry.coordinates", F.lit(0))
    last = F.get("geometry.coordinates", F.size("geometry.coordinates") - 1)
    return tracks.select(
        "mmsi", "point_count", "start_time", "end_time", F.col("geometry.type").alias("geometry_type"),
        F.get(first, F.lit(0)).alias("first_x"), F.get(last, F.lit(1)).alias("last_y"),
        F.aggregate("points", F.lit(0.0), lambda a, p: a + p["longitude"]).alias("sum_x"),
    )


@query("vessel_trajectory", o.sql(_track_sql("pts"), *o.TO_CLEAN, _POINTS))
def _(w):
    points = search.trajectory_points(w.messages())
    return _flat_track(search.vessel_trajectories(points))


@query(
    "clip_trajectory",
    o.sql(
        f"SELECT * FROM ({_track_sql(f'(SELECT * FROM pts WHERE us <= {NOON_US})')}) UNION ALL "
        f"SELECT mmsi, 0, NULL, NULL, 'LineString', NULL, NULL, 0.0 FROM (SELECT mmsi FROM pts GROUP BY mmsi HAVING min(us) > {NOON_US})",
        *o.TO_CLEAN, _POINTS,
    ),
)
def _(w):
    tracks = search.vessel_trajectories(search.trajectory_points(w.messages()))
    return _flat_track(search.clip_trajectory(tracks, NOON))


@query(
    "recent_positions",
    o.sql(f"SELECT id, mmsi, v.vessel_name, us AS timestamp, {rs('latitude', 'longitude', 'sog')} FROM latest JOIN vessels v USING (mmsi) ORDER BY us DESC, id DESC LIMIT 500", *TO_POSITIONS),
)
def _(w):
    return search.recent_positions(w.messages().drop("vessel_name", "vessel_type"), w.vessels()).select(*POSITION_COLUMNS)


@query("active_vessels", o.sql(f"SELECT mmsi, id FROM latest WHERE us >= {NEWEST} - 900000000", *o.TO_SNAP))
def _(w):
    return search.active_vessels(w.messages()).select("mmsi", "id")


@query("moving_count", o.sql(f"SELECT count(*) AS positions, count(*) FILTER (WHERE sog >= {d(0.5)}) AS moving FROM latest", *o.TO_SNAP))
def _(w):
    return search.moving_count(w.latest())


@query(
    "anomaly_search",
    o.sql(f"SELECT message_id, {ALERT_OUT} FROM alerts WHERE severity = 'high' AND us >= {NOON_US} ORDER BY us DESC, message_id DESC, anomaly_type DESC LIMIT 100 OFFSET 20", *o.TO_ALERTS),
)
def _(w):
    found = search.anomaly_search(w.alerts(), w.messages(), severity="high", start=NOON)
    return search.page(search.newest_alerts_first(found), 100, 20).select("message_id", *ALERT_COLUMNS)


@query("anomaly_search_current", o.sql(f"SELECT message_id, anomaly_type FROM alerts WHERE us BETWEEN {NEWEST} - 3600000000 AND {NEWEST}", *o.TO_ALERTS))
def _(w):
    found = search.anomaly_search(w.alerts(), w.messages(), current_only=True, active_minutes=60)
    return found.select("message_id", "anomaly_type")


@query("anomaly_types", o.sql("SELECT mmsi, array_to_string(list_sort(list(DISTINCT anomaly_type)), '|') AS anomaly_types FROM alerts GROUP BY mmsi", *o.TO_ALERTS))
def _(w):
    return search.anomaly_types(w.alerts())


_GRAVEST = f"{RANK} DESC, risk.ml_anomaly_percentile DESC, us DESC, message_id DESC"


@query(
    "risk_search",
    o.sql(f"SELECT {RISK_OUT} FROM risk WHERE ml_anomaly_percentile >= 90 AND detector_agreement ORDER BY {_GRAVEST} LIMIT 100", *o.TO_RISK),
)
def _(w):
    found = search.risk_search(w.risks(), w.messages(), minimum_percentile=90.0, agreement=True)
    return search.page(search.gravest_first(found), 100).select(*RISK_COLUMNS)


@query(
    "page",
    o.sql(f"SELECT message_id, risk_level FROM risk WHERE risk_level <> 'low' ORDER BY {_GRAVEST} LIMIT 25 OFFSET 50", *o.TO_RISK),
)
def _(w):
    elevated = w.risks().filter(F.col("risk_level") != "low")
    return search.page(search.gravest_first(elevated), 25, 50).select("message_id", "risk_level")


@query(
    "vessel_risk_pages",
    o.sql(
        f"""SELECT mmsi, place, message_id, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY {_GRAVEST}) AS place FROM risk)
        WHERE place <= 100""",
        *o.TO_RISK,
    ),
)
def _(w):
    """The first page of every vessel's assessments."""
    return search.vessel_pages(w.risks(), 100).select("mmsi", "place", "message_id", "risk_level")


@query(
    "vessel_risk",
    o.sql(f"SELECT {RISK_OUT} FROM risk WHERE mmsi = (SELECT mmsi FROM clean GROUP BY 1 ORDER BY count(*) DESC, mmsi LIMIT 1)", *o.TO_RISK),
)
def _(w):
    """All assessments of the vessel with the most reports."""
    busiest = w.messages().groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mmsi").first().mmsi
    return search.vessel_risk(w.risks(), w.messages(), w.vessels(), busiest).select(*RISK_COLUMNS)


_SUMMARY = (
    "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE risk_level = '{v}') AS {v}" for v in RISK_LEVELS)
    + ", count(*) FILTER (WHERE risk_level <> 'low') AS elevated, count(*) FILTER (WHERE detector_agreement) AS detector_agreement FROM risk"
)


@query("risk_summary", o.sql(_SUMMARY, *o.TO_RISK))
def _(w):
    return search.risk_summary(w.risks())


@query("risk_summary_current", o.sql(_SUMMARY + f" WHERE us BETWEEN {NEWEST} - 900000000 AND {NEWEST}", *o.TO_RISK))
def _(w):
    return search.risk_summary(search.risk_search(w.risks(), w.messages(), current_only=True))


@query(
    "live_status",
    o.sql(
        """SELECT (SELECT count(*) FROM vessels) AS vessel_count, count(*) AS message_count, max(us) AS latest_timestamp,
        'completed' AS latest_status, FALSE AS ingestion_active FROM clean""",
        *TO_VESSELS,
    ),
)
def _(w):
    """State of the deployment that received both deliveries, from its own registry."""
    from fairlead.catalog.delivery import _store

    store = _store(w)
    return search.live_status(store.vessels.read(), store.messages.read(), store.registry.jobs()).select(
        "vessel_count", "message_count", "latest_timestamp", F.col("latest_import.status").alias("latest_status"), "ingestion_active"
    )


@query(
    "incident_timeline",
    o.sql(
        """SELECT coalesce(k.mmsi, a.mmsi) AS mmsi, coalesce(k.us, a.us) AS timestamp, k.message_id, k.risk_level,
          coalesce(n, 0) AS alert_count, coalesce(types, '') AS alert_types, gravest AS gravest_severity, k.message_id IS NOT NULL AND n IS NOT NULL AS correlated
        FROM (SELECT mmsi, us, min(message_id) AS message_id, min_by(risk_level, message_id) AS risk_level FROM risk GROUP BY 1, 2) k
        FULL OUTER JOIN (
          SELECT mmsi, us, count(*) AS n, array_to_string(list_sort(list(DISTINCT anomaly_type)), '|') AS types,
            CASE max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' ELSE 'warning' END AS gravest
          FROM alerts GROUP BY 1, 2) a ON k.mmsi = a.mmsi AND k.us = a.us""",
        *o.TO_RISK, o.ALERTS,
    ),
)
def _(w):
    elevated = search.incident_timeline(w.risks(), w.alerts())
    return elevated.select(
        "mmsi", "timestamp", "risk.message_id", "risk.risk_level", "alert_count", "alert_types", "gravest_severity", "correlated"
    )


# --- playback ---------------------------------------------------------------------

_DAY = "\nday AS (SELECT * FROM clean WHERE us // 86400000000 = (SELECT us // 86400000000 FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"


@query(
    "playback_bounds",
    o.sql("SELECT min(us) AS start_time, max(us) AS end_time, count(*) AS observation_count, count(DISTINCT mmsi) AS vessel_count FROM day", *o.TO_CLEAN, _DAY),
)
def _(w):
    return playback.playback_bounds(w.messages())


@query(
    "playback_snapshot",
    o.sql(
        f"""SELECT mmsi, id, us AS timestamp FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY us DESC, id DESC) rn
        FROM clean WHERE us BETWEEN {NOON_US} - 300000000 AND {NOON_US}) WHERE rn = 1 ORDER BY mmsi LIMIT 500""",
        *o.TO_CLEAN,
    ),
)
def _(w):
    return search.page(playback.playback_snapshot(w.messages(), NOON).orderBy("mmsi"), 500).select("mmsi", "id", "timestamp")


@query(
    "playback_frames",
    o.sql(
        f"""SELECT frame, mmsi, id FROM (
          SELECT frame, mmsi, id, row_number() OVER (PARTITION BY frame, mmsi ORDER BY us DESC, id DESC) rn
          FROM (SELECT unnest(range(0, 1441)) AS frame) JOIN clean ON us BETWEEN {o.ORIGIN} + frame * 60000000 - 300000000 AND {o.ORIGIN} + frame * 60000000)
        WHERE rn = 1""",
        *o.TO_CLEAN,
    ),
)
def _(w):
    return playback.playback_frames(w.messages(), datetime(2024, 1, 1), datetime(2024, 1, 2)).select("frame", "mmsi", "id")


@query(
    "playback_events",
    o.sql(
        f"""SELECT 'alert' AS kind, message_id FROM alerts WHERE us BETWEEN {NOON_US} - 900000000 AND {NOON_US}
        UNION ALL SELECT 'risk', message_id FROM risk WHERE us BETWEEN {NOON_US} - 900000000 AND {NOON_US}""",
        *o.TO_RISK, o.ALERTS,
    ),
)
def _(w):
    seen = lambda df, kind: playback.playback_events(df, NOON).select(F.lit(kind).alias("kind"), "message_id")
    return seen(w.alerts(), "alert").unionByName(seen(w.risks(), "risk"))


# --- replay -----------------------------------------------------------------------

_BUCKET = "\nbuck AS (SELECT *, (us - (SELECT min(us) FROM clean)) // 300000000 AS bucket FROM clean)"


@query("time_bucket", o.sql("SELECT id, bucket, dense_rank() OVER (ORDER BY bucket) AS sequence FROM buck", *o.TO_CLEAN, _BUCKET))
def _(w):
    return replay.time_bucket(w.messages()).select("id", "bucket", "sequence")


@query("shift_timeline", o.sql(f"SELECT id, us - (SELECT min(us) FROM clean) + {o.ORIGIN + 31_622_400_000_000} AS timestamp FROM clean", *o.TO_CLEAN))
def _(w):
    return replay.shift_timeline(w.messages(), datetime(2025, 1, 1)).select("id", "timestamp")


@query(
    "pseudonymize_mmsi",
    o.sql("SELECT id, CAST(990000000 + dense_rank() OVER (ORDER BY mmsi) AS VARCHAR) AS mmsi FROM clean", *o.TO_CLEAN),
)
def _(w):
    return replay.pseudonymize_mmsi(w.messages()).select("id", "mmsi")


# --- map features -----------------------------------------------------------------

_UNKNOWN = "coalesce({}, 'Unknown vessel')"


@query(
    "sink_geojson",
    o.sql(
        f"""SELECT 'vessel' AS layer, CAST(id AS VARCHAR) AS id, 'Point' AS kind, {r('longitude', 'x')}, {r('latitude', 'y')}, v.vessel_name AS label, {r('coalesce(sog, -1)', 'measure')}
          FROM (SELECT * EXCLUDE (vessel_name) FROM latest) JOIN (SELECT mmsi, {_UNKNOWN.format('vessel_name')} AS vessel_name FROM vessels) v USING (mmsi)
        UNION ALL SELECT 'anomaly', CAST(message_id AS VARCHAR), 'Point', {r('longitude', 'x')}, {r('latitude', 'y')}, anomaly_type, NULL FROM alerts
        UNION ALL SELECT 'risk', CAST(message_id AS VARCHAR), 'Point', {r('longitude', 'x')}, {r('latitude', 'y')}, risk_level, {r('ml_anomaly_percentile', 'measure')} FROM risk
        UNION ALL SELECT 'encounter', message_a || '-' || message_b, 'LineString', {r('longitude_a', 'x')}, {r('latitude_b', 'y')}, {_UNKNOWN.format('name_a')}, {r('tcpa_minutes', 'measure')} FROM details
        UNION ALL SELECT 'midpoint', message_a || '-' || message_b, 'Point', {r('(longitude_a + longitude_b) / 2', 'x')}, {r('(latitude_a + latitude_b) / 2', 'y')}, {_UNKNOWN.format('name_b')}, {r('cpa_distance_nm', 'measure')} FROM details
        UNION ALL SELECT 'trajectory', mmsi, 'LineString', {r('min_by(longitude, point)', 'x')}, {r('max_by(latitude, point)', 'y')}, mmsi, {r('CAST(count(*) AS DOUBLE)', 'measure')} FROM pts GROUP BY mmsi HAVING count(*) >= 2""",
        *o.TO_RISK, o.ALERTS, o.VESSELS, o.LATEST, o.SCAN20, o.ENC, _DETAILS, _POINTS,
    ),
)
def _(w):
    positions = _positions(w)
    tracks = search.vessel_trajectories(search.trajectory_points(w.messages()))

    def flat(layer, features, x, y, label, measure):
        return features.select(
            F.lit(layer).alias("layer"), F.col("id").cast("string").alias("id"), F.col("geometry.type").alias("kind"),
            x.alias("x"), y.alias("y"), F.col(f"properties.{label}").alias("label"), measure.cast("double").alias("measure"),
        )

    point = [F.get("geometry.coordinates", F.lit(i)) for i in (0, 1)]
    ends = [F.get(F.get("geometry.coordinates", F.lit(0)), F.lit(0)), F.get(F.get("geometry.coordinates", F.size("geometry.coordinates") - 1), F.lit(1))]
    prop = lambda c: F.col(f"properties.{c}")
    layers = [
        flat("vessel", geojson.vessel_features(positions), *point, "vesselName", prop("sog")),
        flat("anomaly", geojson.anomaly_features(w.alerts()), *point, "anomalyType", F.lit(None)),
        flat("risk", geojson.risk_features(w.risks()), *point, "riskLevel", prop("mlPercentile")),
        flat("encounter", geojson.encounter_line_features(w.encounter_details()), *ends, "vesselAName", prop("tcpaMinutes")),
        flat("midpoint", geojson.encounter_midpoint_features(w.encounter_details()), *point, "vesselBName", prop("cpaDistanceNm")),
        flat("trajectory", geojson.trajectory_features(tracks), *ends, "mmsi", prop("points")),
    ]
    result = layers[0]
    for layer in layers[1:]:
        result = result.unionByName(layer)
    return result


@query(
    "marker_thinning",
    o.sql(
        """SELECT id FROM ann WHERE has_anomaly UNION ALL
        SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY us, id) AS rn, count(*) OVER (PARTITION BY mmsi) AS n FROM ann WHERE NOT has_anomaly)
        WHERE CASE WHEN n > 5 THEN (rn - 1) % greatest(1, n // 5) = 0 AND (rn - 1) // greatest(1, n // 5) < 5 ELSE TRUE END""",
        *o.TO_ANN,
    ),
)
def _(w):
    return geojson.marker_thinning(w.annotated(), 5).select("id")


@query(
    "map_extent",
    o.sql(
        f"""SELECT mmsi, {r('min(latitude)', 'min_latitude')}, {r('max(latitude)', 'max_latitude')}, {r('min(longitude)', 'min_longitude')},
        {r('max(longitude)', 'max_longitude')}, {r('quantile_cont(latitude, 0.5)', 'median_latitude')}, {r('quantile_cont(longitude, 0.5)', 'median_longitude')}
        FROM clean GROUP BY mmsi""",
        *o.TO_CLEAN,
    ),
)
def _(w):
    return geojson.map_extent(w.messages())
