"""Consecutive numbers in a given order without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.session import cut_lineage


def same(names: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    """Equality of the named columns in which nulls are equal."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names], F.lit(True))


def numbered(
    df: DataFrame,
    order: Sequence[str | Column],
    within: Sequence[str] = (),
    name: str = "number",
    total: str | None = None,
    store: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Add ``name``: 0, 1, ... in ``order`` within each group, and ``total``: the rows of the group.

    Rows are dealt to ranges of about equal size by (within, order) and stored
    with the number of their range. Each range is numbered by itself and starts
    at the number of rows in the ranges before it, so what one task sees is a
    range, however many rows a group has; the sums run over one row per range
    and group. Rows that tie in ``order`` get consecutive numbers in any order;
    a row whose whole key ties with very many others should carry a tie-breaker.
    Nulls form a group of their own. An empty table stays empty.
    """
    ranged = store(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*within, "_range").orderBy(*order)
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        *within,
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(Window.partitionBy(*within)).alias(total)] if total else []),
    )
    rows = ranged.withColumn(name, F.row_number().over(inside) - 1)
    joined = rows.join(starts, same([*within, "_range"], rows, starts), "inner")
    return joined.select(
        *[rows[c] for c in df.columns],
        (F.col("_start") + rows[name]).cast("bigint").alias(name),
        *([starts[total].cast("bigint").alias(total)] if total else []),
    )
