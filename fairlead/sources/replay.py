"""Re-timing and pseudonymising a recording for replay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from fairlead.functions import coerce
from fairlead.operators.numbering import numbered

BUCKET_SECONDS = 300.0
FIRST_NUMBER = 990_000_001
LAST_NUMBER = 999_999_999


def time_bucket(df: DataFrame, seconds: float = BUCKET_SECONDS) -> DataFrame:
    """Fixed-width buckets from the first report, numbered over the non-empty ones.

    The distinct buckets are numbered by ranges, so no task sees all of them.
    """
    if seconds <= 0:
        raise ValueError("The bucket width must be positive.")
    width = int(seconds * 1_000_000)
    origin = df.agg(F.unix_micros(F.min("timestamp"))).scalar()
    placed = df.withColumn("bucket", F.floor((F.unix_micros("timestamp") - origin) / F.lit(width)).cast("bigint"))
    numbers = numbered(placed.select("bucket").dropna().distinct(), ["bucket"], name="_number")
    numbers = numbers.select("bucket", (F.col("_number") + 1).alias("sequence"))
    return placed.join(numbers, "bucket").withColumn("offset_seconds", F.col("bucket") * float(seconds))


def shift_timeline(df: DataFrame, start: datetime) -> DataFrame:
    """Move the recording so that its first report happens at ``start``."""
    origin = df.agg(F.unix_micros(F.min("timestamp"))).scalar()
    return df.withColumn(
        "timestamp", F.timestamp_micros(F.lit(coerce.utc_micros(start)) + F.unix_micros("timestamp") - origin)
    )


def mmsi_mapping(df: DataFrame, first: int = FIRST_NUMBER) -> DataFrame:
    """Deterministic stand-in number per vessel, in order of the sorted real ones.

    The distinct numbers are ranked by ranges. More than fit the nine-digit range
    are an error, raised where the first number too many is used.
    """
    cleaned = F.trim("mmsi")
    vessels = df.select(cleaned.alias("mmsi")).filter("mmsi <> ''").distinct()
    ranked = numbered(vessels, ["mmsi"], name="_number")
    if ranked.isEmpty():
        raise ValueError("The recording contains no MMSI values.")
    if not 100_000_000 <= first <= LAST_NUMBER:
        raise ValueError("Stand-in numbers must stay within nine digits.")
    number = F.col("_number") + first
    fits = F.when(number <= LAST_NUMBER, number).otherwise(
        F.raise_error(F.lit("Stand-in numbers must stay within nine digits.")).cast("bigint")
    )
    return ranked.select("mmsi", fits.cast("string").alias("pseudonym"))


def pseudonymize_mmsi(df: DataFrame, first: int = FIRST_NUMBER) -> DataFrame:
    mapping = mmsi_mapping(df, first)
    return (
        df.withColumn("mmsi", F.trim("mmsi"))
        .join(mapping, "mmsi")
        .withColumn("mmsi", F.col("pseudonym"))
        .drop("pseudonym")
    )


def replay(df: DataFrame, start: datetime, seconds: float = BUCKET_SECONDS, pseudonyms: bool = True) -> DataFrame:
    bucketed = shift_timeline(time_bucket(df, seconds), start)
    return pseudonymize_mmsi(bucketed) if pseudonyms else bucketed


def write_time_batches(bucketed: DataFrame, path: str) -> None:
    """CSV batches, one folder per bucket; a bucket with many rows may span several files.

    The rebalance hint groups small buckets and splits a crowded one over several
    writing tasks, by the sizes seen at run time.
    """
    spread = bucketed.hint("rebalance", "sequence")
    stamped = spread.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ssXXX"))
    (
        stamped.sortWithinPartitions("sequence", "timestamp")
        .drop("bucket", "offset_seconds")
        .write.mode("overwrite")
        .partitionBy("sequence")
        .option("header", True)
        .csv(path)
    )
