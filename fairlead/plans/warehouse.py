"""The stored tables that search, summary and playback queries read.

Each table is built once per session by the same operators that are public, and
written to the shared folder; queries then scan it with column pruning and
predicate pushdown, as they would in a deployment that is fed incrementally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.operators import cleaning, encounters, hybrid, linking, motion, rules
from fairlead.session import cut_lineage
from fairlead.sources.events import raw_reports

_open: dict[tuple[str, str], "Warehouse"] = {}


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _open:
            _open[key] = cls(spark, sf_dir)
        return _open[key]

    def _stored(self, name: str, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = cut_lineage(build())
        return self._tables[name]

    def raw(self) -> DataFrame:
        return raw_reports(self.spark, self.sf_dir)

    def standardized(self) -> DataFrame:
        return cleaning.standardize(self.raw())

    def messages(self) -> DataFrame:
        """Accepted reports with their quality flags and a stand-in model score."""
        return self._stored("messages", lambda: cleaning.accepted(self.standardized()))

    def vessels(self) -> DataFrame:
        return self._stored("vessels", lambda: linking.vessel_dim(self.messages()))

    def annotated(self) -> DataFrame:
        return self._stored("annotated", lambda: rules.annotate(motion.live_features(self.messages())))

    def alerts(self) -> DataFrame:
        return self._stored(
            "alerts",
            lambda: rules.explode_alerts(self.annotated(), keep=("id",)).withColumnRenamed("id", "message_id"),
        )

    def assessed(self) -> DataFrame:
        """Assessments with what they are read by; the other features stay with the annotated reports."""
        kept = ("id", "mmsi", "timestamp", "latitude", "longitude", "ml_anomaly_score", *hybrid.FLAGS)
        return self._stored("assessed", lambda: hybrid.fit_assess(self.annotated().select(*kept)))

    def risks(self) -> DataFrame:
        return self.assessed().select(
            F.col("id").alias("message_id"),
            "mmsi",
            "timestamp",
            "latitude",
            "longitude",
            "ml_anomaly_score",
            "ml_anomaly_percentile",
            "rule_flag_count",
            "rule_severity",
            "detector_agreement",
            "risk_level",
            "risk_reasons",
        )

    def latest(self) -> DataFrame:
        """One row per vessel; a deployment keeps it up to date with every batch."""
        return self._stored("latest", lambda: encounters.latest_reports(self.messages()))

    def snapshot(self) -> DataFrame:
        if "snapshot" not in self._tables:
            self._tables["snapshot"] = encounters.snapshot_of(self.latest())
        return self._tables["snapshot"]

    def encounters(self) -> DataFrame:
        return self._stored("encounters", lambda: encounters.encounter_records(self.snapshot()))

    def encounter_details(self) -> DataFrame:
        from fairlead.plans.search import encounter_details

        return encounter_details(self.encounters(), self.messages(), self.vessels())
