"""Queries of the cleaning, motion and rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.catalog import oracle_base as o
from fairlead.catalog.oracle_base import d, r, rs
from fairlead.catalog.registry import query
from fairlead.functions import coerce, geo
from fairlead.operators import cleaning, linking, motion, profile, rules
from fairlead.schema import RULE_NAMES, RULES

FLAGS = "sog_unavailable, sog_invalid, cog_unavailable, cog_invalid, heading_unavailable, heading_invalid"
CORE_OUT = f"mmsi, us AS timestamp, {rs('latitude', 'longitude')}"
MEASURES = rs("sog", "cog", "heading")

# Text versions of typed columns, so that the text operators have something to do.
_TEXT = """
txt AS (
  SELECT ord, '  ' || coalesce(vessel_name, '') || ' ' AS vessel_name, mmsi || CASE WHEN ord % 3 = 0 THEN '.0' ELSE '' END AS mmsi,
    CASE WHEN sog < 0 THEN 'n/a' ELSE ' ' || printf('%.1f', sog) END AS sog,
    CASE WHEN event_type = 'error' THEN 'not a time'
         WHEN event_type = 'view' THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || '+02:00'
         ELSE strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') || 'Z' END AS timestamp,
    CASE event_type WHEN 'click' THEN ' TRUE ' WHEN 'view' THEN 'yes' WHEN 'signup' THEN '1' WHEN 'error' THEN NULL ELSE 'no' END AS flag
  FROM raw)"""


def _text(w):
    raw = w.raw()
    kind = F.col("event_type")
    stamp = lambda pattern: F.date_format("timestamp", pattern)
    return raw.select(
        "ord",
        F.concat(F.lit("  "), F.coalesce("vessel_name", F.lit("")), F.lit(" ")).alias("vessel_name"),
        F.concat("mmsi", F.when(F.col("ord") % 3 == 0, ".0").otherwise("")).alias("mmsi"),
        F.when(F.col("sog") < 0, "n/a").otherwise(F.format_string(" %.1f", "sog")).alias("sog"),
        F.when(kind == "error", "not a time")
        .when(kind == "view", F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .otherwise(F.concat(stamp("yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
        .alias("timestamp"),
        F.when(kind == "click", " TRUE ").when(kind == "view", "yes").when(kind == "signup", "1")
        .when(kind != "error", "no").alias("flag"),
    )


@query("trim_text", o.sql("SELECT ord, mmsi, nullif(trim(vessel_name), '') AS vessel_name FROM txt", o.RAW, _TEXT))
def _(w):
    return cleaning.trim_text(_text(w)).select("ord", "mmsi", "vessel_name")


@query("normalize_mmsi", o.sql("SELECT ord, CASE WHEN mmsi LIKE '%.0' THEN left(mmsi, length(mmsi) - 2) ELSE mmsi END AS mmsi FROM txt", o.RAW, _TEXT))
def _(w):
    return _text(w).select("ord", coerce.mmsi_text(F.col("mmsi")).alias("mmsi"))


@query("coerce_numeric", o.sql(f"SELECT ord, {r('TRY_CAST(trim(sog) AS DOUBLE)', 'sog')} FROM txt", o.RAW, _TEXT))
def _(w):
    text = _text(w)
    return text.select("ord", coerce.number(text, "sog").alias("sog"))


@query(
    "coerce_timestamp",
    o.sql(
        """SELECT ord, CASE WHEN timestamp = 'not a time' THEN NULL
             WHEN timestamp LIKE '%+02:00' THEN epoch_us(CAST(replace(left(timestamp, 19), 'T', ' ') AS TIMESTAMP)) - 7200000000
             ELSE epoch_us(CAST(left(timestamp, 19) AS TIMESTAMP)) END AS timestamp FROM txt""",
        o.RAW, _TEXT,
    ),
)
def _(w):
    text = _text(w)
    return text.select("ord", coerce.instant(text, "timestamp").alias("timestamp"))


@query(
    "coerce_timestamp_forms",
    o.sql("SELECT ord, CASE WHEN ord % 7 IN (0, 3) THEN us // 60000000 * 60000000 ELSE us // 1000000 * 1000000 END AS timestamp FROM raw", o.RAW),
)
def _(w):
    """Times written in seven forms and read again: month first, slashes, month names, twelve hours, seconds since 1970."""
    forms = ["MM/dd/yyyy HH:mm", "yyyy/M/d H:mm:ss", "d MMM yyyy HH:mm:ss", "MMMM d, yyyy h:mm a", "M-d-yyyy h:mm:ss a", "dd-MMM-yyyy'T'HH:mm:ss"]
    text = F.unix_seconds("timestamp").cast("string")
    for number, form in enumerate(forms):
        text = F.when(F.col("ord") % 7 == number, F.date_format("timestamp", form)).otherwise(text)
    written = w.raw().select("ord", F.concat(F.lit(" "), text).alias("timestamp"))
    return written.select("ord", coerce.instant(written, "timestamp").alias("timestamp"))


@query("coerce_boolean", o.sql("SELECT ord, coalesce(lower(trim(flag)) IN ('true', '1', 'yes'), FALSE) AS flag FROM txt", o.RAW, _TEXT))
def _(w):
    text = _text(w)
    return text.select("ord", coerce.truth(text, "flag").alias("flag"))


@query(
    "validate_core",
    o.sql("SELECT ord, invalid_mmsi, invalid_timestamp, invalid_latitude, invalid_longitude, is_valid_core_record FROM std", *o.BASE),
)
def _(w):
    return cleaning.validate_core(w.raw()).select("ord", *cleaning.INVALID, "is_valid_core_record")


@query("null_sentinels", o.sql(f"SELECT ord, {MEASURES}, {FLAGS} FROM std", *o.BASE))
def _(w):
    return cleaning.null_sentinels(w.raw()).select("ord", "sog", "cog", "heading", *cleaning.QUALITY_FLAGS)


@query("flag_duplicates", o.sql("SELECT ord, duplicate_record FROM std", *o.BASE))
def _(w):
    return cleaning.flag_duplicates(w.raw()).select("ord", "duplicate_record")


@query(
    "split_accept_reject",
    o.sql(
        f"""SELECT 'accepted' AS part, ord, {CORE_OUT}, {MEASURES} FROM clean
        UNION ALL SELECT 'rejected', ord, {CORE_OUT}, {MEASURES} FROM std WHERE NOT is_valid_core_record""",
        *o.TO_CLEAN,
    ),
)
def _(w):
    parts = cleaning.clean(w.raw())
    columns = ["ord", "mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "heading"]
    return (
        parts.accepted.select(F.lit("accepted").alias("part"), *columns)
        .unionByName(parts.rejected.select(F.lit("rejected").alias("part"), *columns))
    )


_COUNT = lambda c: f"count(*) FILTER (WHERE {c}) AS {c}"
_ISO = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%S.%f')"


@query(
    "quality_report",
    o.sql(
        f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE is_valid_core_record AND NOT duplicate_record) AS rows_clean,
        count(*) FILTER (WHERE NOT is_valid_core_record) AS rows_rejected, count(*) FILTER (WHERE duplicate_record) AS duplicates_removed,
        count(DISTINCT mmsi) FILTER (WHERE is_valid_core_record) AS unique_mmsi_clean,
        {', '.join(_COUNT(c) for c in cleaning.INVALID + cleaning.QUALITY_FLAGS)},
        {_ISO.format('min(us) FILTER (WHERE is_valid_core_record)')} AS earliest_timestamp,
        {_ISO.format('max(us) FILTER (WHERE is_valid_core_record)')} AS latest_timestamp FROM std""",
        *o.BASE,
    ),
)
def _(w):
    return cleaning.quality_report(w.standardized())


_PROFILED = ("mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "heading", "vessel_name", "vessel_type")
_NUM = ("latitude", "longitude", "sog", "cog", "heading")


def _profile_sql() -> str:
    col = {c: ("us" if c == "timestamp" else c) for c in _PROFILED}
    rows = [
        ("table", "rows", "count(*)"),
        ("table", "columns", f"max({len(_PROFILED)})"),
        ("mmsi", "distinct", "count(DISTINCT mmsi)"),
        ("timestamp", "min", "min(us) / 1e6"),
        ("timestamp", "max", "max(us) / 1e6"),
        ("timestamp", "invalid", "count(*) FILTER (WHERE us IS NULL)"),
        ("latitude", "outside", "count(*) FILTER (WHERE NOT latitude BETWEEN -90 AND 90)"),
        ("longitude", "outside", "count(*) FILTER (WHERE NOT longitude BETWEEN -180 AND 180)"),
        ("sog", "unavailable", f"count(*) FILTER (WHERE sog = {d(102.3)})"),
        ("sog", "negative", "count(*) FILTER (WHERE sog < 0)"),
        ("cog", "unavailable", "count(*) FILTER (WHERE cog = 360)"),
    ]
    rows += [(c, "missing", f"count(*) FILTER (WHERE {col[c]} IS NULL)") for c in _PROFILED]
    for c in _NUM:
        rows += [(c, "count", f"count({c})"), (c, "mean", f"avg({c})"), (c, "std", f"stddev_samp({c})"),
                 (c, "min", f"min({c})"), (c, "max", f"max({c})")]
        rows += [(c, f"p{int(p * 100)}", f"quantile_cont({c}, {p})") for p in (0.25, 0.5, 0.75)]
    body = "\nUNION ALL ".join(
        f"SELECT '{s}' AS subject, '{m}' AS metric, {r(f'CAST({e} AS DOUBLE)', 'value')} FROM raw" for s, m, e in rows
    )
    keys = ", ".join(col[c] for c in _PROFILED)
    body += (
        f"\nUNION ALL SELECT 'table', 'duplicate_rows', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM raw)) AS DOUBLE) FROM raw"
    )
    return o.sql(body, o.RAW)


@query("profile_table", _profile_sql())
def _(w):
    return profile.profile_table(w.raw().select(*_PROFILED))


@query(
    "import_validate",
    o.sql(f"SELECT TRUE AS usable, ord, {CORE_OUT} FROM std WHERE is_valid_core_record UNION ALL "
          f"SELECT FALSE, ord, {CORE_OUT} FROM std WHERE NOT is_valid_core_record", *o.BASE),
)
def _(w):
    good, bad = linking.import_validate(w.raw())
    columns = ["ord", "mmsi", "timestamp", "latitude", "longitude"]
    return good.select(F.lit(True).alias("usable"), *columns).unionByName(bad.select(F.lit(False).alias("usable"), *columns))


@query(
    "range_null_features",
    o.sql(f"""SELECT ord, {r('CASE WHEN latitude BETWEEN -90 AND 90 THEN latitude END', 'latitude')},
        {r('CASE WHEN longitude BETWEEN -180 AND 180 THEN longitude END', 'longitude')},
        {r('CASE WHEN sog >= 0 THEN sog END', 'sog')}, {r('CASE WHEN cog >= 0 AND cog < 360 THEN cog END', 'cog')},
        {r('CASE WHEN heading >= 0 AND heading < 360 THEN heading END', 'heading')} FROM raw""", o.RAW),
)
def _(w):
    return cleaning.range_null_features(w.raw()).select("ord", "latitude", "longitude", "sog", "cog", "heading")


_BREAKS = "coalesce(sog < 0, FALSE) OR coalesce(cog < 0 OR cog >= 360, FALSE) OR coalesce(heading < 0 OR heading >= 360, FALSE)"


@query("check_constraints", o.sql(f"SELECT ord, NOT ({_BREAKS}) AS passes FROM raw", o.RAW))
def _(w):
    passing, failing = cleaning.check_constraints(w.raw())
    return passing.select("ord", F.lit(True).alias("passes")).unionByName(failing.select("ord", F.lit(False).alias("passes")))


@query(
    "message_project",
    o.sql(f"""SELECT id, {CORE_OUT}, {MEASURES}, CAST(NULL AS BIGINT) AS navigation_status, CAST(NULL AS BIGINT) AS cargo,
        CAST(NULL AS VARCHAR) AS transceiver_class, sog_unavailable, cog_unavailable, heading_unavailable,
        'POINT' AS position_kind, {r('longitude', 'position_x')}, {r('latitude', 'position_y')} FROM clean""", *o.TO_CLEAN),
)
def _(w):
    records = linking.message_project(w.messages())
    part = lambda i: F.regexp_extract("position", r"^POINT\((\S+) (\S+)\)$", i).cast("double")
    return records.select(
        "*", F.substring("position", 1, 5).alias("position_kind"), part(1).alias("position_x"), part(2).alias("position_y")
    ).drop("position")


# --- motion ---------------------------------------------------------------------

_CONSECUTIVE = """
lagged AS (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(cog) OVER w AS pcog
  FROM raw WINDOW w AS (ORDER BY ord))"""


@query("haversine_nm", o.sql(f"SELECT id, {r(o.haversine('latitude', 'longitude', d(40.7), d(-74.0)), 'distance_nm')} FROM clean", *o.TO_CLEAN))
def _(w):
    return w.messages().select(
        "id", geo.haversine_nm(F.col("latitude"), F.col("longitude"), F.lit(40.7), F.lit(-74.0)).alias("distance_nm")
    )


_TURN = o.turn("cog - heading")


@query("angle_change", o.sql(f"SELECT id, {r(f'abs({_TURN})', 'change')} FROM clean", *o.TO_CLEAN))
def _(w):
    return w.messages().select("id", geo.angle_change(F.col("cog"), F.col("heading")).alias("change"))


_MOTION = (
    "elapsed_seconds", "reporting_gap_minutes", "distance_nm", "calculated_speed_knots", "speed_difference_knots",
    "course_change_degrees", "heading_change_degrees", "acceleration_knots_per_minute",
)
_MORE = ("absolute_acceleration_knots_per_minute", "turn_rate_degrees_per_minute")
_TRAJ = o.features("traj", "clean", tie="ord", mask=True, absolute=False)


@query(
    "trajectory_metrics",
    o.sql(f"""SELECT ord, {CORE_OUT}, nonpositive_time_interval, {rs(*_MOTION)}, {r('sog - psog', 'sog_change_knots')},
        pus AS previous_timestamp, {r('plat', 'previous_latitude')}, {r('plon', 'previous_longitude')},
        {r('pcog', 'previous_cog')}, {r('phead', 'previous_heading')},
        {r('sum(coalesce(distance_nm, 0)) OVER (PARTITION BY mmsi ORDER BY us, ord ROWS UNBOUNDED PRECEDING)', 'cumulative_distance_nm')}
        FROM traj""", *o.TO_CLEAN, _TRAJ),
)
def _(w):
    columns = [
        "ord", "mmsi", "timestamp", "latitude", "longitude", "nonpositive_time_interval", *_MOTION, "sog_change_knots",
        "previous_timestamp", "previous_latitude", "previous_longitude", "previous_cog", "previous_heading",
        "cumulative_distance_nm",
    ]
    return motion.trajectory_metrics(w.messages()).select(*columns)


@query(
    "ais_features",
    o.sql(f"SELECT ord, {CORE_OUT}, {MEASURES}, {rs(*_MOTION, *_MORE)} FROM af", *o.TO_CLEAN, o.features("af", "clean", tie="ord")),
)
def _(w):
    return motion.ais_features(w.messages()).select(
        "ord", "mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "heading", *_MOTION, *_MORE
    )


@query(
    "live_features",
    o.sql(f"SELECT id, {CORE_OUT}, {MEASURES}, nonpositive_time_interval, {rs(*_MOTION, *_MORE)} FROM feat", *o.TO_FEAT),
)
def _(w):
    return motion.live_features(w.messages()).select(
        "id", "mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "heading", "nonpositive_time_interval", *_MOTION, *_MORE
    )


@query(
    "trajectory_summary",
    o.sql(f"""SELECT mmsi, count(*) AS observations, min(us) AS first_timestamp, max(us) AS last_timestamp,
        {r('coalesce(sum(distance_nm), 0)', 'total_distance_nm')}, {r('max(reporting_gap_minutes)', 'maximum_gap_minutes')},
        {r('max(calculated_speed_knots)', 'maximum_calculated_speed_knots')}, {r('avg(sog)', 'average_sog_knots')},
        {r('max(course_change_degrees)', 'maximum_course_change_degrees')} FROM traj GROUP BY mmsi""", *o.TO_CLEAN, _TRAJ),
)
def _(w):
    return motion.trajectory_summary(motion.trajectory_metrics(w.messages()))


@query("busiest_vessel", o.sql("SELECT mmsi, count(*) AS reports FROM clean GROUP BY mmsi ORDER BY reports DESC, mmsi LIMIT 1", *o.TO_CLEAN))
def _(w):
    return motion.busiest_vessel(w.messages())


# --- rules ----------------------------------------------------------------------

_SHORT = {
    "reporting_gap": "rule_reporting_gap",
    "position_jump": "rule_position_jump",
    "speed_mismatch": "rule_speed_mismatch",
    "rapid_course_change": "rule_course_change",
    "rapid_heading_change": "rule_heading_change",
    "extreme_acceleration": "rule_acceleration",
    "nonpositive_interval": "rule_nonpositive",
}


def _rule(rule: str, metric: str) -> None:
    @query(_SHORT[rule], o.sql(f"SELECT id, mmsi, us AS timestamp, {r(metric, 'metric')} FROM ann WHERE flag_{rule}", *o.TO_ANN))
    def _(w):
        flagged = rules.rule_flag(motion.live_features(w.messages()), rule)
        return flagged.filter(f"flag_{rule}").select("id", "mmsi", "timestamp", F.col(metric).alias("metric"))


for _name, _, _metric in RULES:
    _rule(_name, _metric)


_FLAG_LIST = ", ".join(f"flag_{n}" for n in RULE_NAMES)


@query(
    "annotate_anomalies",
    o.sql(f"SELECT id, mmsi, us AS timestamp, {_FLAG_LIST}, CAST(anomaly_count AS BIGINT) AS anomaly_count, has_anomaly, anomaly_types FROM ann", *o.TO_ANN),
)
def _(w):
    return rules.annotate(motion.live_features(w.messages())).select(
        "id", "mmsi", "timestamp", *[f"flag_{n}" for n in RULE_NAMES], "anomaly_count", "has_anomaly", "anomaly_types"
    )


ALERT_OUT = f"{CORE_OUT}, anomaly_type, severity, metric_name, {rs('metric_value', 'threshold')}, message"
ALERT_COLUMNS = (
    "mmsi", "timestamp", "latitude", "longitude", "anomaly_type", "severity", "metric_name", "metric_value", "threshold", "message",
)


@query("explode_alerts", o.sql(f"SELECT message_id, {ALERT_OUT} FROM alerts", *o.TO_ALERTS))
def _(w):
    return rules.explode_alerts(w.annotated(), keep=("id",)).withColumnRenamed("id", "message_id")


@query(
    "alert_summary",
    o.sql(
        f"""SELECT (SELECT count(*) FROM ann) AS observations, (SELECT count(*) FROM ann WHERE has_anomaly) AS anomalous_observations,
        count(*) AS alerts, {', '.join(f"count(*) FILTER (WHERE anomaly_type = '{n}') AS {n}" for n in RULE_NAMES)},
        {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS severity_{s}" for s in ('warning', 'high', 'critical'))},
        {r(d(60), 'jump_threshold')} FROM alerts""",
        *o.TO_ALERTS,
    ),
)
def _(w):
    summary = rules.alert_summary(w.annotated())
    count = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return summary.select(
        "observations", "anomalous_observations", "alerts",
        *[count("alerts_by_type", n).alias(n) for n in RULE_NAMES],
        *[count("alerts_by_severity", s).alias(f"severity_{s}") for s in ("warning", "high", "critical")],
        F.element_at("thresholds", "position_jump").alias("jump_threshold"),
    )
