"""Validation of imported tables and their links to stored messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.functions import coerce
from fairlead.schema import CORE, RISK_LEVELS, RULE_SEVERITIES, VESSEL_METADATA, require_columns

RISK_VERSION = "hybrid-v1"
ALERT_KEY = ("message_id", "anomaly_type")
MESSAGE_KEY = ("mmsi", "timestamp", "latitude", "longitude")


def _core_types(df: DataFrame, *numbers: str) -> DataFrame:
    typed = {c: coerce.number(df, c) for c in numbers}
    typed["mmsi"] = coerce.mmsi_text(F.col("mmsi").cast("string"))
    typed["timestamp"] = coerce.instant(df, "timestamp")
    return df.withColumns(typed)


def _placed() -> Column:
    return F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)


def _split(df: DataFrame, valid: Column, store: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable and unusable rows; NULL in the test counts as unusable. ``store`` keeps the marked rows for both."""
    marked = df.withColumn("_valid", coerce.false_if_null(valid))
    marked = marked if store is None else store(marked)
    return marked.filter("_valid").drop("_valid"), marked.filter("not _valid").drop("_valid")


def import_validate(df: DataFrame, store: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The importer's own check of a report file; with ``store`` both results read one stored copy."""
    require_columns(df, CORE, "AIS import")
    numbers = [c for c in ("latitude", "longitude", "sog", "cog", "heading", "navigation_status", "cargo",
                           "vessel_type", "length_m", "width_m", "draft_m") if c in df.columns]
    typed = _core_types(df, *numbers)
    return _split(typed, coerce.is_mmsi(F.col("mmsi")) & F.col("timestamp").isNotNull() & _placed(), store)


def alert_validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = ("anomaly_type", "severity", "metric_name", "message")
    require_columns(df, CORE + texts, "alert")
    typed = _core_types(df, "latitude", "longitude", "metric_value", "threshold").withColumns(
        {c: coerce.text_or_null(F.col(c).cast("string")) for c in texts}
    )
    filled = F.col("timestamp").isNotNull() & _placed()
    for c in texts:
        filled = filled & F.col(c).isNotNull()
    return _split(typed, coerce.is_mmsi(F.col("mmsi")) & filled)


def risk_validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    numbers = ("ml_anomaly_score", "ml_anomaly_percentile", "rule_flag_count")
    require_columns(
        df,
        ("mmsi", "timestamp", *numbers, "rule_severity", "detector_agreement", "risk_level", "risk_reasons"),
        "risk import",
    )
    lowered = {c: F.lower(F.trim(F.col(c).cast("string"))) for c in ("rule_severity", "risk_level")}
    typed = _core_types(df, *numbers).withColumns(
        {
            **lowered,
            "detector_agreement": coerce.truth(df, "detector_agreement"),
            "risk_reasons": coerce.text_or_null(F.col("risk_reasons").cast("string")),
        }
    )
    valid = (
        coerce.is_mmsi(F.col("mmsi"))
        & F.col("timestamp").isNotNull()
        & F.col("ml_anomaly_score").isNotNull()
        & F.col("ml_anomaly_percentile").between(0.0, 100.0)
        & (F.col("rule_flag_count") >= 0.0)
        & F.col("rule_severity").isin(*RULE_SEVERITIES)
        & F.col("risk_level").isin(*RISK_LEVELS)
        & F.col("risk_reasons").isNotNull()
    )
    good, bad = _split(typed, valid)
    return good.withColumn("rule_flag_count", F.col("rule_flag_count").try_cast("int")), bad


def message_project(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Message record of a validated report row; ``keep`` names further columns."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return df.select(
        *keep,
        "id",
        "mmsi",
        "timestamp",
        "latitude",
        "longitude",
        # Much cheaper than a format with placeholders, and the same text.
        F.concat(F.lit("POINT("), shown("longitude"), F.lit(" "), shown("latitude"), F.lit(")")).alias("position"),
        *[coerce.number(df, c).alias(c) for c in ("sog", "cog", "heading")],
        *[coerce.whole_number(df, c).alias(c) for c in ("navigation_status", "cargo")],
        coerce.text(df, "transceiver_class").alias("transceiver_class"),
        *[coerce.truth(df, c).alias(c) for c in ("sog_unavailable", "cog_unavailable", "heading_unavailable")],
    )


def vessel_dim(reports: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Last known metadata and first/last time of every vessel; partial aggregation only."""
    texts = ("imo", "vessel_name", "call_sign")

    def latest(name: str) -> Column:
        if name not in reports.columns:
            return F.lit(None).cast("string" if name in texts else "double")
        value = coerce.text(reports, name) if name in texts else coerce.number(reports, name)
        # The last value present in the file, even if it then reads as no value.
        return F.max_by(value, F.when(F.col(name).isNotNull(), F.col(ordinal)))

    return reports.groupBy("mmsi").agg(
        *[latest(c).try_cast("int" if c == "vessel_type" else "string" if c in texts else "decimal(8,2)").alias(c)
          for c in VESSEL_METADATA],
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def merge_vessels(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """New metadata wins where present; the seen interval only grows."""
    new, old = incoming.alias("n"), stored.alias("o")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return old.join(new, F.col("o.mmsi") == F.col("n.mmsi"), "full_outer").select(
        pick("mmsi"),
        *[pick(c) for c in VESSEL_METADATA],
        F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
    )


def link_alerts(alerts: DataFrame, messages: DataFrame) -> DataFrame:
    """Alerts with the id of the message they stem from, found by exact identity."""
    return alerts.join(_ids_for(alerts, messages, MESSAGE_KEY), list(MESSAGE_KEY), "left")


def link_risk(assessed: DataFrame, messages: DataFrame) -> DataFrame:
    """Assessments with a message id by vessel and time; of equal times the largest id."""
    return assessed.join(_ids_for(assessed, messages, ("mmsi", "timestamp")), ["mmsi", "timestamp"], "left")


def _ids_for(rows: DataFrame, messages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Largest message id per key, for the keys in ``rows`` only.

    The semi join comes first: with few rows to link the messages are filtered
    where they are scanned and never shuffled as a whole.
    """
    asked = messages.join(rows.select(*keys).distinct(), list(keys), "left_semi")
    return asked.groupBy(*keys).agg(F.max("id").alias("message_id"))


def matched(linked: DataFrame) -> DataFrame:
    return linked.filter("message_id is not null")


def unmatched_count(linked: DataFrame) -> DataFrame:
    return linked.agg(
        F.count("message_id").alias("matched"), F.count_if(F.col("message_id").isNull()).alias("messages_not_found")
    )


def incoming_keys(df: DataFrame) -> DataFrame:
    """Distinct valid (mmsi, timestamp) of a new file; only two columns are read."""
    require_columns(df, ("mmsi", "timestamp"), "identity")
    keys = _core_types(df.select("mmsi", "timestamp"))
    return keys.filter(coerce.is_mmsi(F.col("mmsi")) & F.col("timestamp").isNotNull()).distinct()


def affected_history(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """All reports of the batch's vessels up to the batch's last time."""
    until = keys.agg(F.max("timestamp")).scalar()
    vessels = keys.select("mmsi").distinct()
    return messages.filter(F.col("timestamp") <= until).join(vessels, "mmsi", "left_semi")


def restrict_to_incoming(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, ["mmsi", "timestamp"], "left_semi")


def last_per_key(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
