import pytest

from fairlead.config import ApproachThresholds, RuleThresholds
from fairlead.operators import rules

SCHEMA = (
    "mmsi string, timestamp string, reporting_gap_minutes double, elapsed_seconds double, calculated_speed_knots double, "
    "speed_difference_knots double, course_change_degrees double, heading_change_degrees double, "
    "acceleration_knots_per_minute double, sog double, nonpositive_time_interval string"
)
BUSY = ("123456789.0", "2024-01-01T00:05:00Z", 5.0, 300.0, 80.0, -20.0, 100.0, 95.0, -9.0, 10.0, "false")


def types(spark, row, limits=RuleThresholds()):
    annotated, alerts = rules.detect(spark.createDataFrame([row], SCHEMA), limits)
    return annotated.first(), alerts


def test_short_interval_fires_five(spark):
    row, alerts = types(spark, BUSY)
    assert row.anomaly_types == "position_jump,speed_mismatch,rapid_course_change,rapid_heading_change,extreme_acceleration"
    assert row.anomaly_count == 5 and row.has_anomaly and row.mmsi == "123456789.0"
    found = {a.anomaly_type: a for a in alerts.collect()}
    assert found["speed_mismatch"].metric_value == 20.0 and found["extreme_acceleration"].metric_value == 9.0
    assert found["position_jump"].message == "Position change implies 80.00 knots, exceeding the 60.00-knot threshold."
    assert found["position_jump"].latitude is None


def test_long_interval_fires_only_gap(spark):
    row, _ = types(spark, BUSY[:2] + (20.0, 1200.0) + BUSY[4:])
    assert row.anomaly_types == "reporting_gap"


def test_slow_vessel_has_no_turns(spark):
    row, _ = types(spark, BUSY[:9] + (0.5, "false"))
    assert "turn" not in row.anomaly_types and not row.flag_rapid_course_change and not row.flag_rapid_heading_change


def test_nonpositive_by_flag_or_elapsed(spark):
    assert types(spark, BUSY[:10] + (" Yes ",))[0].flag_nonpositive_interval
    assert types(spark, BUSY[:3] + (0.0,) + BUSY[4:])[0].flag_nonpositive_interval


def test_missing_metrics_and_thresholds(spark):
    bare = spark.createDataFrame([("123456789", "2024-01-01")], "mmsi string, timestamp string")
    assert rules.annotate(bare).first().anomaly_types == ""
    with pytest.raises(ValueError, match="mmsi"):
        rules.annotate(bare.drop("mmsi"))
    limits = RuleThresholds(reporting_gap_minutes=4.0, position_jump_speed_knots=90.0)
    assert types(spark, BUSY, limits)[0].anomaly_types.startswith("reporting_gap,speed_mismatch")


def test_threshold_order():
    with pytest.raises(ValueError):
        ApproachThresholds(critical_cpa_nm=0.6)
    with pytest.raises(ValueError):
        ApproachThresholds(medium_tcpa_minutes=-1.0)
