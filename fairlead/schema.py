"""Column names, lists and codes that are part of the data contract."""

from __future__ import annotations

# Source column keys (lower case, letters and digits only) and canonical names.
SOURCE_COLUMNS = {
    "mmsi": "mmsi",
    "basedatetime": "timestamp",
    "lat": "latitude",
    "lon": "longitude",
    "sog": "sog",
    "cog": "cog",
    "heading": "heading",
    "vesselname": "vessel_name",
    "imo": "imo",
    "callsign": "call_sign",
    "vesseltype": "vessel_type",
    "status": "navigation_status",
    "length": "length_m",
    "width": "width_m",
    "draft": "draft_m",
    "cargo": "cargo",
    "transceiverclass": "transceiver_class",
}
CORE = ("mmsi", "timestamp", "latitude", "longitude")
NUMERIC = (
    "latitude", "longitude", "sog", "cog", "heading",
    "vessel_type", "navigation_status", "length_m", "width_m", "draft_m",
)
TEXT = ("mmsi", "vessel_name", "imo", "call_sign", "cargo", "transceiver_class")

# Rule names in reporting order with severity, metric and message.
RULES = (
    ("reporting_gap", "warning", "reporting_gap_minutes"),
    ("position_jump", "critical", "calculated_speed_knots"),
    ("speed_mismatch", "high", "speed_difference_knots"),
    ("rapid_course_change", "warning", "course_change_degrees"),
    ("rapid_heading_change", "warning", "heading_change_degrees"),
    ("extreme_acceleration", "high", "acceleration_knots_per_minute"),
    ("nonpositive_interval", "high", "elapsed_seconds"),
)
RULE_NAMES = tuple(name for name, _, _ in RULES)
RULE_MESSAGES = {
    "reporting_gap": "AIS reporting gap was %.2f minutes, exceeding the %.2f-minute threshold.",
    "position_jump": "Position change implies %.2f knots, exceeding the %.2f-knot threshold.",
    "speed_mismatch": "Calculated and reported speed differed by %.2f knots, exceeding the %.2f-knot threshold.",
    "rapid_course_change": "Course changed by %.2f degrees, exceeding the %.2f-degree threshold.",
    "rapid_heading_change": "Heading changed by %.2f degrees, exceeding the %.2f-degree threshold.",
    "extreme_acceleration": "Speed changed at %.2f knots per minute, exceeding the %.2f threshold.",
    "nonpositive_interval": "Elapsed time was %.2f seconds; it must be greater than %.2f.",
}
RISK_LEVELS = ("low", "medium", "high", "critical")
RULE_SEVERITIES = ("none", "warning", "high", "critical")

# Model inputs, and the ones that only mean something in context.
MODEL_FEATURES = (
    "sog",
    "reporting_gap_minutes",
    "distance_nm",
    "calculated_speed_knots",
    "speed_difference_knots",
    "course_change_degrees",
    "heading_change_degrees",
    "absolute_acceleration_knots_per_minute",
    "turn_rate_degrees_per_minute",
)
MOTION_FEATURES = MODEL_FEATURES[2:]
TURN_FEATURES = ("course_change_degrees", "heading_change_degrees", "turn_rate_degrees_per_minute")

VESSEL_METADATA = ("imo", "vessel_name", "call_sign", "vessel_type", "length_m", "width_m", "draft_m")


def require_columns(df, names, what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required {what} columns: {', '.join(missing)}")
