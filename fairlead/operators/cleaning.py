"""Cleaning of raw reports: naming, typing, validation, sentinels, duplicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.functions import coerce
from fairlead.functions.fence import evaluate_once
from fairlead.schema import CORE, NUMERIC, SOURCE_COLUMNS, TEXT, require_columns

INVALID = ("invalid_mmsi", "invalid_timestamp", "invalid_latitude", "invalid_longitude")
QUALITY_FLAGS = (
    "sog_unavailable", "sog_invalid", "cog_unavailable", "cog_invalid",
    "heading_unavailable", "heading_invalid",
)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Give known source columns their canonical names and keep unknown ones."""
    renamed = df.select(
        [
            F.col(f"`{name}`").alias(SOURCE_COLUMNS.get(re.sub("[^a-z0-9]", "", name.lower()), name))
            for name in df.columns
        ]
    )
    require_columns(renamed, CORE, "AIS")
    return renamed


def trim_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: coerce.text_or_null(F.col(c).cast("string")) for c in TEXT if c in df.columns})


def coerce_types(df: DataFrame, day_first: bool = False) -> DataFrame:
    """Typed core and numeric columns; what cannot be read becomes NULL."""
    typed = {c: coerce.number(df, c) for c in NUMERIC if c in df.columns}
    typed["mmsi"] = coerce.mmsi_text(F.col("mmsi").cast("string"))
    typed["timestamp"] = coerce.instant(df, "timestamp", day_first)
    return df.withColumns(typed)


def validate_core(df: DataFrame) -> DataFrame:
    """Four per-field flags and their summary; missing values are invalid."""
    checked = df.withColumns(
        {
            "invalid_mmsi": ~coerce.is_mmsi(F.col("mmsi")),
            "invalid_timestamp": F.col("timestamp").isNull(),
            "invalid_latitude": ~coerce.false_if_null(F.col("latitude").between(-90, 90)),
            "invalid_longitude": ~coerce.false_if_null(F.col("longitude").between(-180, 180)),
        }
    )
    broken = F.lit(False)
    for flag in INVALID:
        broken = broken | F.col(flag)
    return checked.withColumn("is_valid_core_record", ~broken)


def null_sentinels(df: DataFrame) -> DataFrame:
    """Flag and blank the codes that mean "not available" and impossible values."""

    def known(name: str, condition: Column) -> Column:
        return coerce.false_if_null(condition) if name in df.columns else F.lit(False)

    sog, cog, heading = (
        F.col(c) if c in df.columns else F.lit(None).cast("double") for c in ("sog", "cog", "heading")
    )
    flags = {
        "sog_unavailable": known("sog", sog == 102.3),
        "sog_invalid": known("sog", (sog < 0) | (sog > 102.3)),
        "cog_unavailable": known("cog", cog == 360.0),
        "cog_invalid": known("cog", (cog < 0) | (cog > 360.0)),
        "heading_unavailable": known("heading", heading == 511),
        "heading_invalid": known("heading", (heading < 0) | ((heading >= 360) & (heading != 511))),
    }
    flagged = df.withColumns(flags)
    blanked = {
        c: F.when(~(F.col(f"{c}_unavailable") | F.col(f"{c}_invalid")), F.col(c))
        for c in ("sog", "cog", "heading")
        if c in df.columns
    }
    return flagged.withColumns(blanked) if blanked else flagged


def standardize(df: DataFrame, day_first: bool = False) -> DataFrame:
    """Everything that works row by row: one narrow stage on the scan.

    ``day_first`` reads numeric dates as day, month, year (``coerce.is_day_first`` tells for a file).
    """
    checked = validate_core(coerce_types(trim_text(normalize_columns(df)), day_first))
    return null_sentinels(evaluate_once(checked, [*CORE, *INVALID, "is_valid_core_record"]))


def flag_duplicates(df: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Mark every later copy of the same (mmsi, timestamp, position); NULLs are equal.

    The first ordinal of each key comes from a map-side-combined aggregate and is
    joined back on the ordinal itself, so a key with any number of copies spreads
    over all tasks instead of meeting in one.
    """
    firsts = df.groupBy(*CORE).agg(F.min(ordinal).alias(ordinal)).select(ordinal, F.lit(True).alias("_first"))
    return (
        df.join(firsts, ordinal, "left")
        .withColumn("duplicate_record", F.col("_first").isNull())
        .drop("_first")
    )


def accepted(standardized: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Valid reports, first copy of each key.

    Copies share their validity (it depends on the key columns only), so the
    filter comes before the deduplication. ``row_number() = 1`` is limited to one
    row per key inside each map task before the shuffle.
    """
    first = Window.partitionBy(*CORE).orderBy(F.col(ordinal))
    return (
        standardized.filter("is_valid_core_record")
        .withColumn("_copy", F.row_number().over(first))
        .filter("_copy = 1")
        .drop("_copy")
    )


def rejected(standardized: DataFrame) -> DataFrame:
    """Invalid reports, copies included."""
    return standardized.filter(~F.col("is_valid_core_record"))


@dataclass(frozen=True)
class Cleaned:
    accepted: DataFrame
    rejected: DataFrame
    report: DataFrame


def clean(df: DataFrame, ordinal: str = "ord", day_first: bool = False) -> Cleaned:
    standardized = standardize(df, day_first)
    return Cleaned(accepted(standardized, ordinal), rejected(standardized), quality_report(standardized))


def in_report_order(df: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Total order for a written or displayed result: a range shuffle, not one task."""
    return df.orderBy("mmsi", "timestamp", ordinal)


def quality_report(standardized: DataFrame) -> DataFrame:
    """All counters in one row from one pass over the reports.

    Grouping by the duplicate key first makes the copies collapse before the
    shuffle; the second level only sees one row per distinct key.
    """
    flags = INVALID + QUALITY_FLAGS
    per_key = standardized.groupBy(*CORE, "is_valid_core_record").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )
    valid = F.col("is_valid_core_record")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    per_vessel = per_key.groupBy("mmsi").agg(
        F.sum("_rows").alias("rows_read"),
        F.count_if(valid).alias("rows_clean"),
        F.sum(F.when(~valid, F.col("_rows")).otherwise(0)).alias("rows_rejected"),
        F.sum(F.col("_rows") - 1).alias("duplicates_removed"),
        F.max(valid.cast("int")).alias("unique_mmsi_clean"),
        *[F.sum(f).alias(f) for f in flags],
        F.min(F.when(valid, F.col("timestamp"))).alias("earliest"),
        F.max(F.when(valid, F.col("timestamp"))).alias("latest"),
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    counters = ("rows_read", "rows_clean", "rows_rejected", "duplicates_removed", "unique_mmsi_clean") + flags
    return per_vessel.agg(
        *[total(F.col(c)).alias(c) for c in counters],
        F.date_format(F.min("earliest"), iso).alias("earliest_timestamp"),
        F.date_format(F.max("latest"), iso).alias("latest_timestamp"),
    )


def range_null_features(df: DataFrame) -> DataFrame:
    """Blank positions and measures outside their physical range."""
    inside = {
        "latitude": F.col("latitude").between(-90.0, 90.0),
        "longitude": F.col("longitude").between(-180.0, 180.0),
        "sog": F.col("sog") >= 0.0,
        "cog": (F.col("cog") >= 0.0) & (F.col("cog") < 360.0),
        "heading": (F.col("heading") >= 0.0) & (F.col("heading") < 360.0),
    }
    return df.withColumns({c: F.when(test, F.col(c)) for c, test in inside.items()})


def check_constraints(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split by the stored table's limits on speed, course and heading.

    A NULL measure passes. Rows outside go to quarantine instead of failing a load.
    """
    sog, cog, heading = F.col("sog"), F.col("cog"), F.col("heading")
    breaks = coerce.false_if_null(
        (sog < 0)
    ) | coerce.false_if_null((cog < 0) | (cog >= 360)) | coerce.false_if_null((heading < 0) | (heading >= 360))
    return df.filter(~breaks), df.filter(breaks)
