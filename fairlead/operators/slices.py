"""Window operations over very long keys, split into time slices.

A plain ``Window.partitionBy("mmsi")`` sorts all rows of one vessel in one task,
and one vessel may hold a third of all reports. Here the rows are partitioned by
(key, slice) with a slice of fixed length in time, and what must cross a slice
border (the last row, a running count, a running sum) travels in a small table
with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SIX_HOURS = 6 * 3600
_LAST_SLICE = 9_000_000_000_000_000


def time_slice(key: str, timestamp: str, spread: Column, seconds: int) -> Column:
    """Slice number; rows without a time come last, rows without a key are spread."""
    return (
        F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)))
        .when(F.col(timestamp).isNull(), F.lit(_LAST_SLICE))
        .otherwise(F.floor(F.unix_micros(timestamp) / F.lit(seconds * 1_000_000)))
        .cast("bigint")
    )


def with_slice(df: DataFrame, key: str, timestamp: str, tie: str, seconds: int) -> DataFrame:
    return df.withColumn("_slice", time_slice(key, timestamp, F.col(tie), seconds))


def _order(timestamp: str, tie: str) -> list[Column]:
    return [F.col(timestamp).asc_nulls_last(), F.col(tie).asc()]


def with_previous(
    df: DataFrame,
    carry: list[str],
    *,
    key: str = "mmsi",
    timestamp: str = "timestamp",
    tie: str = "ord",
    seconds: int = SIX_HOURS,
) -> DataFrame:
    """Add struct ``_prev`` with the ``carry`` columns of the preceding row of the key.

    NULL for the first row of a key. Rows are left partitioned and sorted by
    (key, slice), so later slice windows need no further shuffle.
    """
    sliced = with_slice(df, key, timestamp, tie, seconds)
    window = Window.partitionBy(key, "_slice").orderBy(*_order(timestamp, tie))
    state = F.struct(*[F.col(c) for c in carry])
    last_rows = (
        sliced.filter(F.col(key).isNotNull())
        .groupBy(key, "_slice")
        .agg(F.max_by(state, F.struct(F.col(timestamp), F.col(tie))).alias("_last"))
    )
    across = Window.partitionBy(key).orderBy("_slice")
    borders = last_rows.select(key, "_slice", F.lag("_last").over(across).alias("_border"))
    return (
        sliced.withColumn("_inside", F.when(F.col(key).isNotNull(), F.lag(state).over(window)))
        .join(borders, [key, "_slice"], "left")
        .withColumn("_prev", F.coalesce("_inside", "_border"))
        .drop("_inside", "_border")
    )


def with_running_sum(
    df: DataFrame,
    value: str,
    name: str,
    *,
    key: str = "mmsi",
    timestamp: str = "timestamp",
    tie: str = "ord",
) -> DataFrame:
    """Running sum per key over rows that already carry ``_slice``."""
    window = Window.partitionBy(key, "_slice").orderBy(*_order(timestamp, tie)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    amount = F.coalesce(F.col(value), F.lit(0.0))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(key, "_slice")
        .agg(F.sum(amount).alias("_sum"))
        .select(key, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    )
    return (
        df.withColumn("_inside", F.sum(amount).over(window))
        .join(offsets, [key, "_slice"], "left")
        .withColumn(name, F.coalesce("_before", F.lit(0.0)) + F.col("_inside"))
        .drop("_inside", "_before")
    )


def with_position(
    df: DataFrame,
    name: str = "position",
    *,
    key: str = "mmsi",
    timestamp: str = "timestamp",
    tie: str = "ord",
    seconds: int = SIX_HOURS,
    count: str | None = None,
) -> DataFrame:
    """1-based position of each row within its key, and optionally the key's row count."""
    sliced = with_slice(df, key, timestamp, tie, seconds)
    window = Window.partitionBy(key, "_slice").orderBy(*_order(timestamp, tie))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")]
    if count:
        columns.append(F.sum("_n").over(Window.partitionBy(key)).alias(count))
    offsets = (
        sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(key, "_slice", *columns)
    )
    return (
        sliced.withColumn("_inside", F.row_number().over(window))
        .join(offsets, [key, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_inside", "_before", "_slice")
    )
