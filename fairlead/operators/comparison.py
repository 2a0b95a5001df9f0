"""How the model's verdicts and the rules agree, and how scores are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fairlead.functions import coerce
from fairlead.operators import ranking
from fairlead.schema import RULE_NAMES, require_columns

TOP_SHARES = (10.0, 5.0, 2.0, 1.0, 0.5)
PERCENTILES = (0.50, 0.75, 0.90, 0.95, 0.98, 0.99, 0.995)


def with_verdicts(df: DataFrame) -> DataFrame:
    """Booleans ``ml_is_anomaly`` and ``rule_is_anomaly`` from any spelling."""
    require_columns(df, ("ml_is_anomaly", "ml_anomaly_score"), "comparison")
    flags = [F.col(f"flag_{r}").cast("int") for r in RULE_NAMES]
    return df.withColumns(
        {"ml_is_anomaly": coerce.truth(df, "ml_is_anomaly"), "rule_flag_count": sum(flags, F.lit(0))}
    ).withColumn("rule_is_anomaly", F.col("rule_flag_count") > 0)


def contingency(df: DataFrame) -> DataFrame:
    """Agreement table, overlap and per-rule counts in one aggregation."""
    ml, rule = F.col("ml_is_anomaly"), F.col("rule_is_anomaly")
    both = F.count_if(ml & rule)
    return df.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(ml).alias("ml_anomalies"),
        F.count_if(rule).alias("rule_anomalies"),
        both.alias("both"),
        F.count_if(ml & ~rule).alias("ml_only"),
        F.count_if(~ml & rule).alias("rules_only"),
        F.count_if(~ml & ~rule).alias("neither"),
        F.try_divide(both * 100.0, F.count_if(ml)).alias("ml_also_rules_percent"),
        *[F.count_if(F.col(f"flag_{r}")).alias(f"rule_{r}") for r in RULE_NAMES],
    )


def examples(df: DataFrame, limit: int = 10) -> DataFrame:
    """Highest scores within each class of agreement.

    Only ``limit`` rows per class leave a map task, so three classes are enough keys.
    """
    ml, rule = F.col("ml_is_anomaly"), F.col("rule_is_anomaly")
    kind = F.when(ml & rule, "both").when(ml, "ml_only").when(rule, "rules_only")
    best = Window.partitionBy("class").orderBy(F.col("ml_anomaly_score").desc_nulls_last(), "id")
    return (
        df.withColumn("class", kind)
        .filter("class is not null")
        .withColumn("class_rank", F.row_number().over(best))
        .filter(F.col("class_rank") <= limit)
    )


def score_tails(df: DataFrame, shares: tuple[float, ...] = TOP_SHARES) -> DataFrame:
    """Threshold of each top share, rows at or above it, and their rule overlap."""
    limits = ranking.exact_quantiles(df, ["ml_anomaly_score"], [1.0 - s / 100.0 for s in shares])["ml_anomaly_score"]
    score = F.col("ml_anomaly_score")
    counts = df.agg(
        *[F.count_if(score >= t).alias(f"rows{i}") for i, t in enumerate(limits)],
        *[F.count_if((score >= t) & F.col("rule_is_anomaly")).alias(f"hits{i}") for i, t in enumerate(limits)],
    )
    rows = [
        F.struct(
            F.lit(float(s)).alias("top_percent"),
            F.lit(t).cast("double").alias("threshold"),
            F.col(f"rows{i}").alias("selected_rows"),
            F.coalesce(F.try_divide(F.col(f"hits{i}") * 100.0, F.col(f"rows{i}")), F.lit(0.0)).alias(
                "rule_overlap_percent"
            ),
        )
        for i, (s, t) in enumerate(zip(shares, limits))
    ]
    return counts.select(F.inline(F.array(*rows)))


def score_distribution(df: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    values = ranking.exact_quantiles(df, ["ml_anomaly_score"], list(percentiles))["ml_anomaly_score"]
    score = F.col("ml_anomaly_score")
    summary = df.agg(
        F.count(score).alias("count"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    )
    names = [f"p{p * 100:g}".replace(".", "_") for p in percentiles]
    return summary.withColumns({n: F.lit(v).cast("double") for n, v in zip(names, values)})


def context_diagnostics(df: DataFrame) -> DataFrame:
    """Verdicts under conditions that explain them: long gaps, little speed, large turns."""
    ml, rule = F.col("ml_is_anomaly"), F.col("rule_is_anomaly")
    slow_rule_only = rule & ~ml & (F.col("sog") < 3.0)
    return df.agg(
        F.count_if(ml & (F.col("reporting_gap_minutes") > 15.0)).alias("ml_long_gap"),
        F.count_if(rule & (F.col("reporting_gap_minutes") > 15.0)).alias("rule_long_gap"),
        F.count_if(slow_rule_only).alias("rule_only_slow"),
        F.count_if(slow_rule_only & (F.col("course_change_degrees") > 90.0)).alias("rule_only_slow_large_turn"),
    )


def top_scores(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.orderBy(F.col("ml_anomaly_score").desc_nulls_last(), "id").limit(limit)
