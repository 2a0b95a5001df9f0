"""Thresholds of the rules and classifiers."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RuleThresholds:
    reporting_gap_minutes: float = 15.0
    position_jump_speed_knots: float = 60.0
    speed_difference_knots: float = 15.0
    course_change_degrees: float = 90.0
    heading_change_degrees: float = 90.0
    maximum_turn_interval_minutes: float = 10.0
    minimum_turn_speed_knots: float = 3.0
    acceleration_knots_per_minute: float = 8.0


@dataclass(frozen=True)
class PriorityThresholds:
    """Percentile limits of the combined rule and model priority."""

    elevated: float = 95.0
    high: float = 98.0
    very_high: float = 99.0
    extreme: float = 99.5


@dataclass(frozen=True)
class ApproachThresholds:
    """Distance (NM) and time (minutes) limits for close approaches."""

    critical_cpa_nm: float = 0.25
    critical_tcpa_minutes: float = 15.0
    high_cpa_nm: float = 0.50
    high_tcpa_minutes: float = 30.0
    medium_cpa_nm: float = 1.00
    medium_tcpa_minutes: float = 45.0

    def __post_init__(self) -> None:
        if any(getattr(self, f.name) <= 0.0 for f in fields(self)):
            raise ValueError("approach thresholds must be positive")
        for unit in ("cpa_nm", "tcpa_minutes"):
            limits = [getattr(self, f"{level}_{unit}") for level in ("critical", "high", "medium")]
            if limits != sorted(limits):
                raise ValueError(f"{unit} thresholds must not decrease from critical to medium")
