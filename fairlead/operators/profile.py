"""Profile of a report table: missing values, copies, ranges, numeric summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fairlead.functions import coerce
from fairlead.operators.ranking import exact_quantiles
from fairlead.session import cut_lineage

NUMBERS = ("latitude", "longitude", "sog", "cog", "heading", "length_m", "width_m", "draft_m")


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, worst first."""
    total = F.count(F.lit(1))
    counts = df.agg(total.alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in df.columns]
    return (
        counts.select("_rows", F.inline(F.array(*rows)))
        .select(
            "column",
            "missing_count",
            F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("_rows")), F.lit(0.0)).alias(
                "missing_percent"
            ),
        )
        .orderBy(F.desc("missing_percent"), "column")
    )


def profile_table(df: DataFrame, store: bool = True) -> DataFrame:
    """Long table (subject, metric, value).

    Full-row copies are counted from groups of equal rows, which collapse before
    the shuffle; everything else is one conditional aggregation. Several passes
    are needed, so a text source is parsed once into a columnar copy; give
    ``store=False`` for a table that already is one.
    """
    df = cut_lineage(df) if store else df
    numbers = [c for c in NUMBERS if c in df.columns]
    typed = df.withColumns({c: coerce.number(df, c) for c in numbers} | {"timestamp": coerce.instant(df, "timestamp")})
    quantiles = exact_quantiles(typed, numbers, [0.25, 0.5, 0.75])
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("table|duplicate_rows")
    )
    metrics = {
        "table|rows": F.count(F.lit(1)),
        "mmsi|distinct": F.count_distinct("mmsi"),
        "timestamp|min": F.unix_micros(F.min("timestamp")) / 1e6,
        "timestamp|max": F.unix_micros(F.max("timestamp")) / 1e6,
        "timestamp|invalid": F.count_if(F.col("timestamp").isNull()),
        "latitude|outside": F.count_if(~coerce.false_if_null(F.col("latitude").between(-90, 90))),
        "longitude|outside": F.count_if(~coerce.false_if_null(F.col("longitude").between(-180, 180))),
    }
    if "sog" in numbers:
        metrics["sog|unavailable"] = F.count_if(F.col("sog") == 102.3)
        metrics["sog|negative"] = F.count_if(F.col("sog") < 0)
    if "cog" in numbers:
        metrics["cog|unavailable"] = F.count_if(F.col("cog") == 360.0)
    for c in df.columns:
        metrics[f"{c}|missing"] = F.count_if(F.col(c).isNull())
    for c in numbers:
        metrics |= {
            f"{c}|count": F.count(c),
            f"{c}|mean": F.avg(c),
            f"{c}|std": F.stddev_samp(c),
            f"{c}|min": F.min(c),
            f"{c}|max": F.max(c),
        }
    wide = typed.agg(*[m.cast("double").alias(k) for k, m in metrics.items()]).crossJoin(F.broadcast(copies))
    wide = wide.withColumn("table|columns", F.lit(len(df.columns)))
    fixed = {f"{c}|p{p}": F.lit(v) for c in numbers for p, v in zip((25, 50, 75), quantiles[c])}
    values = {k: F.col(f"`{k}`") for k in wide.columns} | fixed
    rows = [
        F.struct(
            F.lit(k.split("|")[0]).alias("subject"),
            F.lit(k.split("|")[1]).alias("metric"),
            v.cast("double").alias("value"),
        )
        for k, v in values.items()
    ]
    return wide.select(F.inline(F.array(*rows)))
