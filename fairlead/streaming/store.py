"""The stored tables of a running deployment, all below one shared folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from fairlead.sources.tables import DatedTable, VersionedTable
from fairlead.streaming.registry import FileRegistry

_MEASURES = "latitude double, longitude double, sog double, cog double, heading double"
MESSAGES = (
    f"id bigint, job_id string, mmsi string, timestamp timestamp, {_MEASURES}, position string, navigation_status int, cargo int, "
    "transceiver_class string, sog_unavailable boolean, cog_unavailable boolean, heading_unavailable boolean"
)
VESSELS = (
    "mmsi string, imo string, vessel_name string, call_sign string, vessel_type int, length_m decimal(8,2), "
    "width_m decimal(8,2), draft_m decimal(8,2), first_seen timestamp, last_seen timestamp"
)
ALERTS = (
    "message_id bigint, mmsi string, timestamp timestamp, latitude double, longitude double, anomaly_type string, "
    "severity string, metric_name string, metric_value double, threshold double, message string"
)
RISKS = (
    "message_id bigint, mmsi string, timestamp timestamp, ml_anomaly_score double, ml_anomaly_percentile double, "
    "rule_flag_count int, rule_severity string, detector_agreement boolean, risk_level string, risk_reasons string, "
    "assessment_version string"
)
ENCOUNTERS = (
    "mmsi_a string, mmsi_b string, message_a bigint, message_b bigint, observed_at timestamp, observed_at_a timestamp, "
    "observed_at_b timestamp, current_distance_nm double, cpa_distance_nm double, tcpa_minutes double, "
    "relative_speed_knots double, closing_speed_knots double, bearing_from_a_to_b_degrees double, risk_level string, "
    "reasons array<string>, assessment_version string"
)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    #: Who claims files; drivers that share the tables have different names.
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def messages(self) -> DatedTable:
        return DatedTable(self.spark, f"{self.root}/messages", MESSAGES, ("mmsi", "timestamp", "latitude", "longitude"))

    @property
    def quarantine(self) -> DatedTable:
        """Valid reports outside the stored limits of speed, course or heading, as they came."""
        keys = ("job_id", "mmsi", "timestamp", "latitude", "longitude")
        return DatedTable(self.spark, f"{self.root}/quarantine", MESSAGES, keys)

    @property
    def latest(self) -> VersionedTable:
        """Newest report per vessel."""
        return VersionedTable(self.spark, f"{self.root}/latest", MESSAGES)

    @property
    def day_ends(self) -> DatedTable:
        """Last report per vessel and day: what later days need of earlier ones."""
        return DatedTable(self.spark, f"{self.root}/day_ends", f"{MESSAGES}, day date", ("mmsi", "day"))

    @property
    def vessels(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/vessels", VESSELS)

    @property
    def alerts(self) -> DatedTable:
        return DatedTable(self.spark, f"{self.root}/alerts", ALERTS, ("message_id", "anomaly_type"))

    @property
    def risks(self) -> DatedTable:
        return DatedTable(self.spark, f"{self.root}/risks", RISKS, ("message_id",))

    @property
    def encounters(self) -> DatedTable:
        keys = ("message_a", "message_b", "assessment_version")
        return DatedTable(self.spark, f"{self.root}/encounters", ENCOUNTERS, keys, "observed_at")

    @property
    def registry(self) -> FileRegistry:
        return FileRegistry(self.spark, f"{self.root}/import_jobs", self.owner)

    @property
    def baseline_path(self) -> str:
        return f"{self.root}/baseline"
