"""Common table expressions in DuckDB SQL that restate the data model.

Written independently of the Spark code: joins are plain joins, windows are
unsliced, pairs come from a cross join of the latest states.
"""

from __future__ import annotations

ORIGIN = 1704067200000000


def d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def r(expression: str, name: str | None = None) -> str:
    return f"floor(({expression}) * {d(1e6)} + {d(0.5)}) / {d(1e6)} + 0.0 AS {name or expression.split('.')[-1]}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def pmod(x: str, n: str = "360.0") -> str:
    n = f"CAST({n} AS DOUBLE)"
    return f"(CASE WHEN ({x}) % {n} < 0 THEN (({x}) % {n} + {n}) % {n} ELSE ({x}) % {n} END)"


def turn(x: str) -> str:
    return f"({pmod(f'({x}) + {d(180)}')} - {d(180)})"


def haversine(la: str, oa: str, lb: str, ob: str) -> str:
    hl, ho = f"sin(radians({lb} - {la}) / 2)", f"sin(radians({ob} - {oa}) / 2)"
    c = f"({hl}*{hl} + cos(radians({la}))*cos(radians({lb}))*{ho}*{ho})"
    c = f"CASE WHEN {c} > 1 THEN {d(1)} WHEN {c} < 0 THEN {d(0)} ELSE {c} END"
    return f"({d(6880.13)} * atan2(sqrt({c}), sqrt({d(1)} - {c})))"


def two(x: str) -> str:
    return f"printf('%.2f', floor({x} * 100 + {d(0.5)}) / 100)"


_lat = f"{d(40.5)} + (u % 50) * {d(0.01)} + ((e * 7919) % 1000) * {d(0.00002)}"
_lon = f"{d(-74.2)} + ((u * 37) % 50) * {d(0.01)} + ((e * 104729) % 1000) * {d(0.00002)}"

RAW = f"""
ev AS (
  SELECT event_id AS e, user_id AS u, event_type, value,
         {ORIGIN} + (epoch_us(ts) - {ORIGIN}) // 20 AS us
  FROM events),
ev2 AS (
  SELECT *, {_lat} AS lat, {_lon} AS lon,
    CASE WHEN e % 97 = 0 THEN {d(102.3)} WHEN e % 211 = 0 THEN {d(-1)}
         ELSE CAST(CAST(round(value * 10) AS BIGINT) % 400 AS DOUBLE) / 10 END AS sog,
    CASE WHEN e % 41 = 0 THEN {d(360)} WHEN e % 223 = 0 THEN {d(500)}
         ELSE CAST((e * 137) % 3600 AS DOUBLE) / 10 END AS cog,
    CASE WHEN e % 3 = 0 THEN {d(511)} WHEN e % 227 = 0 THEN {d(400)}
         ELSE CAST((e * 53) % 360 AS DOUBLE) END AS heading
  FROM ev),
raw AS (
  SELECT e * 4 AS ord, CASE WHEN e % 401 = 0 THEN 'BAD' ELSE CAST(200000000 + u AS VARCHAR) END AS mmsi,
    CASE WHEN e % 409 <> 0 THEN us END AS us,
    CASE WHEN e % 419 = 0 THEN {d(100)} ELSE lat END AS latitude,
    CASE WHEN e % 421 = 0 THEN {d(200)} ELSE lon END AS longitude,
    sog, cog, heading,
    CASE WHEN event_type <> 'error' THEN 'V' || u END AS vessel_name,
    60 + u % 30 AS vessel_type, value AS ml_anomaly_score, event_type
  FROM ev2
  UNION ALL
  SELECT e * 4 + 1, CAST(200000000 + u AS VARCHAR), us, lat, lon, sog, cog, heading, NULL, 60 + u % 30, value, event_type
  FROM ev2 WHERE e % 10 = 5
  UNION ALL
  SELECT e * 4 + 2, CAST(200000000 + u AS VARCHAR), us, lat + {d(0.001)}, lon, sog, cog, heading, NULL, 60 + u % 30, value, event_type
  FROM ev2 WHERE e % 101 = 1)"""

STD = """
std0 AS (
  SELECT raw.* REPLACE (
      CASE WHEN sog = CAST(102.3 AS DOUBLE) OR sog < 0 OR sog > CAST(102.3 AS DOUBLE) THEN NULL ELSE sog END AS sog,
      CASE WHEN cog = 360 OR cog < 0 OR cog > 360 THEN NULL ELSE cog END AS cog,
      CASE WHEN heading < 0 OR heading >= 360 THEN NULL ELSE heading END AS heading),
    ord AS id,
    NOT regexp_full_match(mmsi, '[0-9]{9}') AS invalid_mmsi,
    us IS NULL AS invalid_timestamp,
    NOT (latitude BETWEEN -90 AND 90) AS invalid_latitude,
    NOT (longitude BETWEEN -180 AND 180) AS invalid_longitude,
    sog = CAST(102.3 AS DOUBLE) AS sog_unavailable, sog < 0 OR sog > CAST(102.3 AS DOUBLE) AS sog_invalid,
    cog = 360 AS cog_unavailable, cog < 0 OR cog > 360 AS cog_invalid,
    heading = 511 AS heading_unavailable, heading < 0 OR (heading >= 360 AND heading <> 511) AS heading_invalid,
    row_number() OVER (PARTITION BY mmsi, us, latitude, longitude ORDER BY ord) > 1 AS duplicate_record
  FROM raw),
std AS (
  SELECT *, NOT (invalid_mmsi OR invalid_timestamp OR invalid_latitude OR invalid_longitude) AS is_valid_core_record
  FROM std0)"""

CLEAN = "\nclean AS (SELECT * FROM std WHERE is_valid_core_record AND NOT duplicate_record)"


def features(name: str, source: str, tie: str = "id", mask: bool = False, absolute: bool = True) -> str:
    """Motion features by plain window functions over the whole vessel."""
    guard = lambda x: f"CASE WHEN us > pus THEN {x} END" if mask else x
    diff = "calculated_speed_knots - sog"
    return f"""
{name}_l AS (
  SELECT *, lag(us) OVER w AS pus, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon,
    lag(sog) OVER w AS psog, lag(cog) OVER w AS pcog, lag(heading) OVER w AS phead
  FROM {source} WINDOW w AS (PARTITION BY mmsi ORDER BY us NULLS LAST, {tie})),
{name}_m AS (
  SELECT *, CAST(us - pus AS DOUBLE) / {d(1e6)} AS elapsed_seconds,
    CAST(us - pus AS DOUBLE) / {d(1e6)} / {d(60)} AS reporting_gap_minutes,
    coalesce(us - pus <= 0, FALSE) AS nonpositive_time_interval,
    {guard(haversine('plat', 'plon', 'latitude', 'longitude'))} AS distance_nm,
    {guard(f"abs({turn('cog - pcog')})")} AS course_change_degrees,
    {guard(f"abs({turn('heading - phead')})")} AS heading_change_degrees
  FROM {name}_l),
{name}_n AS (
  SELECT *, CASE WHEN elapsed_seconds > 0 THEN distance_nm / (elapsed_seconds / {d(3600)}) END AS calculated_speed_knots,
    CASE WHEN elapsed_seconds > 0 THEN (sog - psog) / reporting_gap_minutes END AS acceleration_knots_per_minute,
    CASE WHEN elapsed_seconds > 0 THEN course_change_degrees / reporting_gap_minutes END AS turn_rate_degrees_per_minute
  FROM {name}_m),
{name} AS (
  SELECT *, {f'abs({diff})' if absolute else diff} AS speed_difference_knots,
    abs(acceleration_knots_per_minute) AS absolute_acceleration_knots_per_minute
  FROM {name}_n)"""


FEAT = features("feat", "clean")

_FLAGS = {
    "reporting_gap": "reporting_gap_minutes > 15",
    "position_jump": "reporting_gap_minutes > 0 AND reporting_gap_minutes <= 10 AND calculated_speed_knots > 60",
    "speed_mismatch": "reporting_gap_minutes > 0 AND reporting_gap_minutes <= 10 AND abs(speed_difference_knots) > 15",
    "rapid_course_change": "reporting_gap_minutes > 0 AND reporting_gap_minutes <= 10 AND sog >= 3 AND course_change_degrees > 90",
    "rapid_heading_change": "reporting_gap_minutes > 0 AND reporting_gap_minutes <= 10 AND sog >= 3 AND heading_change_degrees > 90",
    "extreme_acceleration": "reporting_gap_minutes > 0 AND reporting_gap_minutes <= 10 AND abs(acceleration_knots_per_minute) > 8",
    "nonpositive_interval": "nonpositive_time_interval",
}
RULES = list(_FLAGS)
_sum = " + ".join(f"CAST(flag_{k} AS INT)" for k in RULES)
_names = "concat_ws(',', " + ", ".join(f"CASE WHEN flag_{k} THEN '{k}' END" for k in RULES) + ")"
ANN = (
    "\nann0 AS (SELECT *, "
    + ", ".join(f"coalesce({v}, FALSE) AS flag_{k}" for k, v in _FLAGS.items())
    + f" FROM feat),\nann AS (SELECT *, {_sum} AS anomaly_count, ({_sum}) > 0 AS has_anomaly, {_names} AS anomaly_types FROM ann0)"
)

_ALERTS = {
    "reporting_gap": ("warning", "reporting_gap_minutes", 15, "AIS reporting gap was {} minutes, exceeding the 15.00-minute threshold."),
    "position_jump": ("critical", "calculated_speed_knots", 60, "Position change implies {} knots, exceeding the 60.00-knot threshold."),
    "speed_mismatch": ("high", "speed_difference_knots", 15, "Calculated and reported speed differed by {} knots, exceeding the 15.00-knot threshold."),
    "rapid_course_change": ("warning", "course_change_degrees", 90, "Course changed by {} degrees, exceeding the 90.00-degree threshold."),
    "rapid_heading_change": ("warning", "heading_change_degrees", 90, "Heading changed by {} degrees, exceeding the 90.00-degree threshold."),
    "extreme_acceleration": ("high", "acceleration_knots_per_minute", 8, "Speed changed at {} knots per minute, exceeding the 8.00 threshold."),
    "nonpositive_interval": ("high", "elapsed_seconds", 0, "Elapsed time was {} seconds; it must be greater than 0.00."),
}


def _alert(rule: str) -> str:
    severity, metric, limit, message = _ALERTS[rule]
    value = f"abs({metric})" if rule in ("speed_mismatch", "extreme_acceleration") else metric
    before, after = message.split("{}")
    return (
        f"SELECT id AS message_id, mmsi, us, latitude, longitude, '{rule}' AS anomaly_type, '{severity}' AS severity, "
        f"'{metric}' AS metric_name, {value} AS metric_value, {d(limit)} AS threshold, "
        f"'{before}' || {two(value)} || '{after}' AS message FROM ann WHERE flag_{rule}"
    )


ALERTS = "\nalerts AS (" + "\nUNION ALL ".join(_alert(k) for k in RULES) + ")"

RISK = f"""
pct AS (
  SELECT *, anomaly_count AS rule_flag_count,
    {d(100)} * (count(*) OVER (ORDER BY ml_anomaly_score)) / (count(*) OVER ()) AS ml_anomaly_percentile,
    CASE WHEN flag_position_jump THEN 'critical'
         WHEN flag_speed_mismatch OR flag_extreme_acceleration OR flag_nonpositive_interval THEN 'high'
         WHEN flag_reporting_gap OR flag_rapid_course_change OR flag_rapid_heading_change THEN 'warning'
         ELSE 'none' END AS rule_severity,
    flag_speed_mismatch OR flag_extreme_acceleration OR flag_nonpositive_interval AS any_high
  FROM ann),
risk AS (
  SELECT *, id AS message_id, rule_flag_count > 0 AND ml_anomaly_percentile >= 95 AS detector_agreement,
    CASE WHEN flag_position_jump OR (ml_anomaly_percentile >= 99 AND rule_flag_count >= 2)
           OR (ml_anomaly_percentile >= 99.5 AND any_high) THEN 'critical'
         WHEN any_high OR ml_anomaly_percentile >= 99.5 OR (ml_anomaly_percentile >= 98 AND rule_flag_count > 0) THEN 'high'
         WHEN rule_flag_count > 0 OR ml_anomaly_percentile >= 95 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN rule_flag_count = 0 AND ml_anomaly_percentile < 95 THEN 'no_elevated_evidence'
         ELSE concat_ws('; ', CASE WHEN rule_flag_count > 0 THEN 'rules=' || anomaly_types END,
              CASE WHEN ml_anomaly_percentile >= 95 THEN 'ml_percentile=' || {two('ml_anomaly_percentile')} END) END AS risk_reasons
  FROM pct)"""

VESSELS = """
vessels AS (
  SELECT mmsi, max_by(vessel_name, ord) FILTER (WHERE vessel_name IS NOT NULL) AS vessel_name,
    CAST(max_by(vessel_type, ord) AS BIGINT) AS vessel_type, min(us) AS first_seen, max(us) AS last_seen
  FROM clean GROUP BY mmsi)"""

LATEST = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY us DESC, id DESC) AS rn FROM clean) WHERE rn = 1),
snap AS (SELECT * FROM latest WHERE sog IS NOT NULL AND cog IS NOT NULL AND sog >= 0)"""


def pairs(radius: float, name: str = "pairs") -> str:
    columns = ("mmsi", "id", "us", "latitude", "longitude", "sog", "cog")
    sides = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in columns)
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT {sides}, {haversine('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS great_circle_nm
    FROM snap a JOIN snap b ON a.mmsi < b.mmsi) WHERE great_circle_nm <= {d(radius)})"""


def approach(source: str = "pairs", name: str = "scan") -> str:
    lon = turn("b_longitude - a_longitude")
    vel = lambda s, f: f"{s}_sog * {f}(radians({pmod(f'{s}_cog')}))"
    within = lambda c, t: f"fcpa <= {d(c)} AND tcpa_minutes <= {d(t)}"
    projected = lambda c, t: (
        f"'Projected closest approach is within {c} NM.|The projected closest approach occurs within {t} minutes.|"
        f"The vessels are closing at ' || {two('closing_speed_knots')} || ' knots.'"
    )
    return f"""
{name}1 AS (
  SELECT *, {lon} * 60 * cos(radians((a_latitude + b_latitude) / 2)) AS x, (b_latitude - a_latitude) * 60 AS y,
    {vel('b', 'sin')} - {vel('a', 'sin')} AS u, {vel('b', 'cos')} - {vel('a', 'cos')} AS v
  FROM {source}),
{name}2 AS (
  SELECT *, sqrt(x*x + y*y) AS current_distance_nm, sqrt(u*u + v*v) AS speed, x*u + y*v AS dot FROM {name}1),
{name}3 AS (
  SELECT *, CASE WHEN abs(x) < 1e-9 AND abs(y) < 1e-9 THEN {d(0)} ELSE {pmod('degrees(atan2(x, y)) + 360')} END
      AS bearing_from_a_to_b_degrees,
    CASE WHEN speed > 1e-9 THEN speed ELSE 0 END AS relative_speed_knots,
    CASE WHEN speed > 1e-9 AND current_distance_nm > 1e-9 THEN -dot / current_distance_nm ELSE {d(0)} END AS closing_speed_knots,
    CASE WHEN speed > 1e-9 THEN -dot / (u*u + v*v) END AS hours
  FROM {name}2),
{name}4 AS (
  SELECT *, hours * 60 AS tcpa_minutes,
    CASE WHEN hours IS NULL THEN current_distance_nm ELSE sqrt((x + u*hours)**2 + (y + v*hours)**2) END AS cpa_distance_nm,
    coalesce(closing_speed_knots > 0 AND hours > 0, FALSE) AS is_closing
  FROM {name}3),
{name}5 AS (
  SELECT *, CASE WHEN hours > 0 THEN cpa_distance_nm ELSE current_distance_nm END AS fcpa FROM {name}4),
{name} AS (
  SELECT *, fcpa AS future_cpa_distance_nm,
    CASE WHEN current_distance_nm <= {d(0.25)} THEN 'critical'
         WHEN tcpa_minutes IS NULL OR tcpa_minutes <= 0 OR NOT is_closing THEN 'low'
         WHEN {within(0.25, 15)} THEN 'critical' WHEN {within(0.5, 30)} THEN 'high'
         WHEN {within(1, 45)} THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN current_distance_nm <= {d(0.25)} THEN 'Current vessel separation is within 0.25 NM.|' ||
           CASE WHEN is_closing THEN 'The vessels are still closing.' ELSE 'The vessels are currently at critical proximity.' END
         WHEN tcpa_minutes IS NULL THEN 'No meaningful TCPA exists because relative vessel motion is negligible.'
         WHEN tcpa_minutes <= 0 OR NOT is_closing THEN 'The vessels are not on a future closing encounter.' ||
           CASE WHEN tcpa_minutes < 0 THEN '|The mathematical closest point of approach has already occurred.' ELSE '' END
         WHEN {within(0.25, 15)} THEN {projected('0.25', '15')}
         WHEN {within(0.5, 30)} THEN {projected('0.50', '30')}
         WHEN {within(1, 45)} THEN {projected('1.00', '45')}
         ELSE 'Projected CPA/TCPA does not meet the configured elevated collision-risk thresholds.' END AS reasons
  FROM {name}5)"""


SCAN20 = pairs(20.0) + "," + approach()
ENC = """
enc AS (
  SELECT a_mmsi AS mmsi_a, b_mmsi AS mmsi_b, a_id AS message_a, b_id AS message_b, greatest(a_us, b_us) AS observed_at,
    a_us AS observed_at_a, b_us AS observed_at_b, current_distance_nm, fcpa AS cpa_distance_nm, tcpa_minutes,
    relative_speed_knots, closing_speed_knots, bearing_from_a_to_b_degrees, risk_level, reasons,
    'cpa-tcpa-v1' AS assessment_version
  FROM scan WHERE risk_level <> 'low' AND abs(a_us - b_us) <= 300000000)"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


BASE = (RAW, STD)
TO_CLEAN = (*BASE, CLEAN)
TO_FEAT = (*TO_CLEAN, FEAT)
TO_ANN = (*TO_FEAT, ANN)
TO_ALERTS = (*TO_ANN, ALERTS)
TO_RISK = (*TO_ANN, RISK)
TO_SNAP = (*TO_CLEAN, LATEST)
TO_ENC = (*TO_SNAP, SCAN20, ENC)
