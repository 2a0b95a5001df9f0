"""Queries of the encounter operators and of search over stored encounters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.catalog import oracle_base as o
from fairlead.catalog.oracle_base import d, r, rs
from fairlead.catalog.registry import query
from fairlead.operators import encounters
from fairlead.plans import search
from fairlead.schema import RISK_LEVELS


@query(
    "latest_snapshot",
    o.sql(f"SELECT mmsi, id, us AS timestamp, {rs('latitude', 'longitude', 'sog', 'cog')} FROM snap", *o.TO_SNAP),
)
def _(w):
    return encounters.usable_snapshot(encounters.latest_reports(w.messages())).select("mmsi", "id", "timestamp", "latitude", "longitude", "sog", "cog")


@query(
    "snapshot_counts",
    o.sql("SELECT (SELECT count(*) FROM latest) AS latest_positions, (SELECT count(*) FROM snap) AS usable_vessels, "
          "(SELECT count(*) FROM latest) - (SELECT count(*) FROM snap) AS skipped_unusable", *o.TO_SNAP),
)
def _(w):
    return encounters.snapshot_counts(w.latest())


@query("motion_validate", o.sql("SELECT id, coalesce(sog >= 0, FALSE) AND cog IS NOT NULL AS usable FROM clean", *o.TO_CLEAN))
def _(w):
    good, bad = encounters.motion_quarantine(w.messages())
    return good.select("id", F.lit(True).alias("usable")).unionByName(bad.select("id", F.lit(False).alias("usable")))


@query("encounter_candidates", o.sql(f"SELECT a_mmsi, b_mmsi, {r('great_circle_nm')} FROM pairs", *o.TO_SNAP, o.pairs(5.0)))
def _(w):
    return encounters.encounter_candidates(w.snapshot()).select("a_mmsi", "b_mmsi", "great_circle_nm")


_LAT = f"degrees({d(5)} / {d(3440.065)})"


@query(
    "candidate_metrics",
    o.sql(
        f"""SELECT (SELECT count(*) FROM snap) AS vessel_count, (SELECT count(*) * (count(*) - 1) // 2 FROM snap) AS possible_pair_count,
        (SELECT count(*) FROM snap a JOIN snap b ON a.mmsi < b.mmsi WHERE abs(a.latitude - b.latitude) <= {_LAT}) AS distance_checked_pair_count,
        (SELECT count(*) FROM pairs) AS candidate_count""",
        *o.TO_SNAP, o.pairs(5.0),
    ),
)
def _(w):
    return encounters.candidate_metrics(w.snapshot())


_APPROACH = (
    "current_distance_nm", "relative_speed_knots", "closing_speed_knots", "bearing_from_a_to_b_degrees", "tcpa_minutes",
    "cpa_distance_nm", "future_cpa_distance_nm",
)


@query("cpa_tcpa", o.sql(f"SELECT a_mmsi, b_mmsi, is_closing, {rs(*_APPROACH)} FROM scan", *o.TO_SNAP, o.SCAN20))
def _(w):
    pairs = encounters.encounter_candidates(w.snapshot(), 20.0)
    return encounters.closest_approach(pairs).select("a_mmsi", "b_mmsi", "is_closing", *_APPROACH)


@query("collision_risk", o.sql("SELECT a_mmsi, b_mmsi, risk_level, reasons FROM scan", *o.TO_SNAP, o.SCAN20))
def _(w):
    return encounters.collision_scan(w.snapshot(), 20.0, include_low=True).select("a_mmsi", "b_mmsi", "risk_level", "reasons")


_SCAN_OUT = ("current_distance_nm", "future_cpa_distance_nm", "tcpa_minutes")


@query(
    "collision_scan",
    o.sql(f"SELECT a_mmsi, b_mmsi, risk_level, {rs(*_SCAN_OUT)} FROM scan WHERE risk_level <> 'low'", *o.TO_SNAP, o.pairs(5.0) + "," + o.approach()),
)
def _(w):
    scan = encounters.by_urgency(encounters.collision_scan(w.snapshot()))
    return scan.select("a_mmsi", "b_mmsi", "risk_level", *_SCAN_OUT)


@query(
    "pair_time_alignment",
    o.sql("SELECT a_mmsi, b_mmsi, greatest(a_us, b_us) AS observed_at FROM pairs WHERE abs(a_us - b_us) <= 300000000", *o.TO_SNAP, o.pairs(20.0)),
)
def _(w):
    pairs = encounters.encounter_candidates(w.snapshot(), 20.0, encounters.MAX_GAP_MINUTES)
    return encounters.pair_time_alignment(pairs).select("a_mmsi", "b_mmsi", "observed_at")


ENC_NUMBERS = (
    "current_distance_nm", "cpa_distance_nm", "tcpa_minutes", "relative_speed_knots", "closing_speed_knots",
    "bearing_from_a_to_b_degrees",
)
ENC_OUT = (
    "mmsi_a, mmsi_b, message_a, message_b, observed_at, observed_at_a, observed_at_b, "
    + rs(*ENC_NUMBERS) + ", risk_level, reasons, assessment_version"
)


@query("persist_encounters", o.sql(f"SELECT {ENC_OUT} FROM enc", *o.TO_ENC))
def _(w):
    return encounters.encounter_records(w.snapshot())


@query(
    "persist_encounters_counts",
    o.sql(
        """SELECT (SELECT count(*) FROM latest) AS latest_position_count, (SELECT count(*) FROM snap) AS usable_vessel_count,
        (SELECT count(*) FROM latest) - (SELECT count(*) FROM snap) AS skipped_unusable_count,
        (SELECT count(*) * (count(*) - 1) // 2 FROM snap) AS possible_pair_count, count(*) AS candidate_count,
        count(*) AS assessed_candidate_count,
        count(*) FILTER (WHERE risk_level <> 'low') AS elevated_encounter_count,
        count(*) FILTER (WHERE risk_level <> 'low' AND abs(a_us - b_us) <= 300000000) AS eligible_encounter_count,
        count(*) FILTER (WHERE risk_level <> 'low' AND abs(a_us - b_us) > 300000000) AS skipped_time_gap_count,
        CAST(0 AS BIGINT) AS inserted_count,
        count(*) FILTER (WHERE risk_level <> 'low' AND abs(a_us - b_us) <= 300000000) AS duplicate_count FROM scan""",
        *o.TO_SNAP, o.SCAN20,
    ),
)
def _(w):
    """Counters of a scan that is stored again: everything is a duplicate."""
    return encounters.store_counters(w.latest(), w.snapshot(), w.encounters())


_CUT = f"((SELECT max(us) FROM clean) - 900000000)"
_CURRENT = f"""
cur AS (
  SELECT enc.* FROM enc WHERE observed_at_a >= {_CUT} AND observed_at_b >= {_CUT}
    AND NOT EXISTS (SELECT 1 FROM clean m WHERE m.mmsi = mmsi_a AND (m.us > observed_at_a OR (m.us = observed_at_a AND m.id > message_a)))
    AND NOT EXISTS (SELECT 1 FROM clean m WHERE m.mmsi = mmsi_b AND (m.us > observed_at_b OR (m.us = observed_at_b AND m.id > message_b))))"""
_KEYS = "mmsi_a, mmsi_b, message_a, message_b, risk_level"
_KEY_COLUMNS = ("mmsi_a", "mmsi_b", "message_a", "message_b", "risk_level")


@query("current_encounters", o.sql(f"SELECT {_KEYS} FROM cur", *o.TO_ENC, _CURRENT))
def _(w):
    return encounters.current_encounters(w.encounters(), w.latest()).select(*_KEY_COLUMNS)


_DETAILS = """
details AS (
  SELECT enc.*, va.vessel_name AS name_a, vb.vessel_name AS name_b, ma.latitude AS latitude_a, ma.longitude AS longitude_a,
    ma.sog AS sog_a, ma.cog AS cog_a, mb.latitude AS latitude_b, mb.longitude AS longitude_b, mb.sog AS sog_b, mb.cog AS cog_b
  FROM enc JOIN vessels va ON va.mmsi = mmsi_a JOIN vessels vb ON vb.mmsi = mmsi_b
  JOIN clean ma ON ma.id = message_a JOIN clean mb ON mb.id = message_b)"""
_STATE = ("latitude_a", "longitude_a", "sog_a", "cog_a", "latitude_b", "longitude_b", "sog_b", "cog_b")


@query("encounter_details", o.sql(f"SELECT {_KEYS}, name_a, name_b, {rs(*_STATE)} FROM details", *o.TO_ENC, o.VESSELS, _DETAILS))
def _(w):
    return w.encounter_details().select(*_KEY_COLUMNS, "name_a", "name_b", *_STATE)


@query(
    "vessel_encounters",
    o.sql("SELECT mmsi_a AS mmsi, mmsi_b AS counterpart, message_a, message_b FROM enc UNION ALL SELECT mmsi_b, mmsi_a, message_a, message_b FROM enc", *o.TO_ENC),
)
def _(w):
    return encounters.vessel_encounters(w.encounters()).select("mmsi", "counterpart", "message_a", "message_b")


_URGENT = "CASE risk_level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query(
    "collision_search",
    o.sql(
        f"SELECT {_KEYS}, {r('tcpa_minutes')} FROM enc WHERE tcpa_minutes BETWEEN 0 AND 40 "
        f"ORDER BY {_URGENT}, enc.tcpa_minutes NULLS LAST, cpa_distance_nm, observed_at DESC, message_a, message_b LIMIT 20 OFFSET 5",
        *o.TO_ENC,
    ),
)
def _(w):
    found = search.collision_search(w.encounters(), w.latest(), minimum_tcpa=0.0, maximum_tcpa=40.0)
    return search.page(search.most_urgent_first(found), 20, 5).select(*_KEY_COLUMNS, "tcpa_minutes")


_LEVELS = ", ".join(f"count(*) FILTER (WHERE risk_level = '{v}') AS {v}" for v in RISK_LEVELS)


@query("collision_summary", o.sql(f"SELECT count(*) AS total, {_LEVELS} FROM enc", *o.TO_ENC))
def _(w):
    return search.collision_summary(w.encounters())


@query("collision_summary_current", o.sql(f"SELECT count(*) AS total, {_LEVELS} FROM cur", *o.TO_ENC, _CURRENT))
def _(w):
    return search.collision_summary(encounters.current_encounters(w.encounters(), w.latest()))
