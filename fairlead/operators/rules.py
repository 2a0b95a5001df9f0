"""The seven deterministic anomaly rules and the alerts they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.config import RuleThresholds
from fairlead.functions import coerce
from fairlead.functions.fence import evaluate_once
from fairlead.schema import RULE_MESSAGES, RULE_NAMES, RULES, require_columns


def _conditions(df: DataFrame, limits: RuleThresholds) -> dict[str, Column]:
    value = lambda name: coerce.number(df, name)
    gap = value("reporting_gap_minutes")
    short_gap = (gap > 0.0) & (gap <= limits.maximum_turn_interval_minutes)
    under_way = short_gap & (value("sog") >= limits.minimum_turn_speed_knots)
    return {
        "reporting_gap": gap > limits.reporting_gap_minutes,
        "position_jump": short_gap & (value("calculated_speed_knots") > limits.position_jump_speed_knots),
        "speed_mismatch": short_gap & (F.abs(value("speed_difference_knots")) > limits.speed_difference_knots),
        "rapid_course_change": under_way & (value("course_change_degrees") > limits.course_change_degrees),
        "rapid_heading_change": under_way & (value("heading_change_degrees") > limits.heading_change_degrees),
        "extreme_acceleration": short_gap
        & (F.abs(value("acceleration_knots_per_minute")) > limits.acceleration_knots_per_minute),
        "nonpositive_interval": coerce.truth(df, "nonpositive_time_interval") | (value("elapsed_seconds") <= 0),
    }


def rule_flag(df: DataFrame, rule: str, limits: RuleThresholds = RuleThresholds()) -> DataFrame:
    """Add one rule's flag only."""
    flag = f"flag_{rule}"
    return evaluate_once(df.withColumn(flag, coerce.false_if_null(_conditions(df, limits)[rule])), [flag])


def flag_rules(df: DataFrame, limits: RuleThresholds = RuleThresholds()) -> DataFrame:
    """Add all seven flags in one projection."""
    flags = {f"flag_{rule}": coerce.false_if_null(test) for rule, test in _conditions(df, limits).items()}
    return evaluate_once(df.withColumns(flags), list(flags))


def annotate(df: DataFrame, limits: RuleThresholds = RuleThresholds()) -> DataFrame:
    """Flags with their count and the comma-separated names of the rules that fired."""
    require_columns(df, ("mmsi", "timestamp"), "anomaly")
    flagged = flag_rules(df, limits)
    count = sum((F.col(f"flag_{r}").cast("int") for r in RULE_NAMES), F.lit(0))
    names = F.concat_ws(",", *[F.when(F.col(f"flag_{r}"), F.lit(r)) for r in RULE_NAMES])
    return flagged.withColumns({"anomaly_count": count, "anomaly_types": names}).withColumn(
        "has_anomaly", F.col("anomaly_count") > 0
    )


def _two_decimals(value: Column) -> Column:
    """Text with two decimals from the nearest hundredth, same in every engine."""
    return F.format_string("%.2f", F.floor(value * 100 + 0.5) / 100)


def _thresholds(limits: RuleThresholds) -> dict[str, float]:
    return {
        "reporting_gap": limits.reporting_gap_minutes,
        "position_jump": limits.position_jump_speed_knots,
        "speed_mismatch": limits.speed_difference_knots,
        "rapid_course_change": limits.course_change_degrees,
        "rapid_heading_change": limits.heading_change_degrees,
        "extreme_acceleration": limits.acceleration_knots_per_minute,
        "nonpositive_interval": 0.0,
    }


def _message(rule: str, metric: Column, threshold: float) -> Column:
    before, after = RULE_MESSAGES[rule].split("%.2f", 1)
    return F.concat(F.lit(before), _two_decimals(metric), F.lit(after % threshold))


def explode_alerts(
    annotated: DataFrame, limits: RuleThresholds = RuleThresholds(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per fired rule, from a single pass over the annotated reports.

    ``keep`` names further columns (a message id) to carry along.
    """
    thresholds = _thresholds(limits)
    unsigned = ("speed_difference_knots", "acceleration_knots_per_minute")
    alerts = []
    for rule, severity, metric in RULES:
        value = coerce.number(annotated, metric)
        value = F.abs(value) if metric in unsigned else value
        alert = F.struct(
            F.lit(rule).alias("anomaly_type"),
            F.lit(severity).alias("severity"),
            F.lit(metric).alias("metric_name"),
            value.alias("metric_value"),
            F.lit(thresholds[rule]).alias("threshold"),
            _message(rule, value, thresholds[rule]).alias("message"),
        )
        alerts.append(F.when(F.col(f"flag_{rule}"), alert))
    place = [
        (F.col(c) if c in annotated.columns else F.lit(None).cast("double")).alias(c)
        for c in ("latitude", "longitude")
    ]
    return (
        annotated.filter(F.array_contains(F.array(*[F.col(f"flag_{r}") for r in RULE_NAMES]), True))
        .select(*keep, "mmsi", "timestamp", *place, F.explode(F.array_compact(F.array(*alerts))).alias("_alert"))
        .select(*keep, "mmsi", "timestamp", "latitude", "longitude", "_alert.*")
    )


def detect(df: DataFrame, limits: RuleThresholds = RuleThresholds()) -> tuple[DataFrame, DataFrame]:
    annotated = annotate(df, limits)
    return annotated, explode_alerts(annotated, limits)


def alert_summary(annotated: DataFrame, limits: RuleThresholds = RuleThresholds()) -> DataFrame:
    """Totals, counts by type and by severity (as maps) and the limits used: one row."""
    fired = lambda rule: F.count_if(F.col(f"flag_{rule}"))
    by_type = F.create_map(*[part for r in RULE_NAMES for part in (F.lit(r), fired(r))])
    severities = {s: [r for r, severity, _ in RULES if severity == s] for s in ("warning", "high", "critical")}
    by_severity = F.create_map(
        *[part for s, rules in severities.items() for part in (F.lit(s), sum((fired(r) for r in rules), F.lit(0)))]
    )
    used = F.create_map(
        *[part for r, limit in _thresholds(limits).items() for part in (F.lit(r), F.lit(float(limit)))]
    )
    positive = lambda m: F.map_filter(m, lambda _, n: n > 0)
    return annotated.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if("has_anomaly").alias("anomalous_observations"),
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("alerts"),
        positive(by_type).alias("alerts_by_type"),
        positive(by_severity).alias("alerts_by_severity"),
    ).withColumn("thresholds", used)
