"""Investigation priority from rule evidence and the model score's percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.config import PriorityThresholds
from fairlead.functions import coerce
from fairlead.operators import ranking
from fairlead.schema import RISK_LEVELS, RULE_NAMES, RULE_SEVERITIES, RULES, require_columns

FLAGS = tuple(f"flag_{name}" for name in RULE_NAMES)


def _any(severity: str) -> Column:
    fired = F.lit(False)
    for name, level, _ in RULES:
        if level == severity:
            fired = fired | F.col(f"flag_{name}")
    return fired


def normalize_flags(df: DataFrame) -> DataFrame:
    missing = [f for f in FLAGS if f not in df.columns]
    if missing:
        raise ValueError(f"Missing required rule column: {', '.join(missing)}")
    return df.withColumns({f: coerce.truth(df, f) for f in FLAGS})


def rule_severity(df: DataFrame) -> DataFrame:
    """Number of fired rules and the gravest severity among them."""
    count = sum((F.col(f).cast("int") for f in FLAGS), F.lit(0))
    gravest = (
        F.when(_any("critical"), "critical").when(_any("high"), "high").when(_any("warning"), "warning")
    )
    return df.withColumns({"rule_flag_count": count, "rule_severity": gravest.otherwise("none")})


def risk_level(df: DataFrame, limits: PriorityThresholds = PriorityThresholds()) -> DataFrame:
    """Level and detector agreement; a missing percentile reaches no limit."""
    reaches = lambda limit: coerce.false_if_null(F.col("ml_anomaly_percentile") >= limit)
    count = F.col("rule_flag_count")
    extreme, elevated = reaches(limits.extreme), reaches(limits.elevated)
    critical = (
        _any("critical") | (reaches(limits.very_high) & (count >= 2)) | (extreme & _any("high"))
    )
    high = _any("high") | extreme | (reaches(limits.high) & (count > 0))
    return df.withColumns(
        {
            "detector_agreement": (count > 0) & elevated,
            "risk_level": F.when(critical, "critical")
            .when(high, "high")
            .when((count > 0) | elevated, "medium")
            .otherwise("low"),
        }
    )


def risk_reasons(df: DataFrame, limits: PriorityThresholds = PriorityThresholds()) -> DataFrame:
    names = F.concat_ws(",", *[F.when(F.col(f), F.lit(f.removeprefix("flag_"))) for f in FLAGS])
    percentile = F.col("ml_anomaly_percentile")
    rounded = F.format_string("%.2f", F.floor(percentile * 100 + 0.5) / 100)
    parts = F.concat_ws(
        "; ",
        F.when(names != "", F.concat(F.lit("rules="), names)),
        F.when(percentile >= limits.elevated, F.concat(F.lit("ml_percentile="), rounded)),
    )
    return df.withColumn("risk_reasons", F.when(parts == "", "no_elevated_evidence").otherwise(parts))


def assess(
    df: DataFrame,
    reference: ranking.ScoreReference,
    limits: PriorityThresholds = PriorityThresholds(),
    spread: str = "id",
) -> DataFrame:
    """All six priority columns for scored and annotated reports."""
    require_columns(df, ("ml_anomaly_score",), "assessment")
    flagged = rule_severity(normalize_flags(df))
    placed = ranking.with_percentile(flagged, reference, spread=spread)
    return risk_reasons(risk_level(placed, limits), limits)


def fit_assess(df: DataFrame, limits: PriorityThresholds = PriorityThresholds(), spread: str = "id") -> DataFrame:
    return assess(df, ranking.fit_reference(df), limits, spread)


def risk_distribution(assessed: DataFrame) -> DataFrame:
    """Rows and share per risk level and rows per rule severity, zeros included.

    One conditional aggregate over the data; the fixed lists become rows afterwards.
    """
    counts = assessed.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_level") == v).alias(f"level_{v}") for v in RISK_LEVELS],
        *[F.count_if(F.col("rule_severity") == v).alias(f"severity_{v}") for v in RULE_SEVERITIES],
    )
    entry = lambda kind, v: F.struct(
        F.lit(kind).alias("kind"), F.lit(v).alias("value"), F.col(f"{kind}_{v}").alias("rows")
    )
    rows = [entry("level", v) for v in RISK_LEVELS] + [entry("severity", v) for v in RULE_SEVERITIES]
    return counts.select("total", F.inline(F.array(*rows))).select(
        "kind",
        "value",
        "rows",
        F.coalesce(F.try_divide(F.col("rows") * 100.0, F.col("total")), F.lit(0.0)).alias("percent"),
    )


def level_rank(level: Column) -> Column:
    """low 1 ... critical 4, anything else 0."""
    ranked = F.lit(0)
    for rank, name in enumerate(RISK_LEVELS, start=1):
        ranked = F.when(level == name, rank).otherwise(ranked)
    return ranked


def top_risk_observations(assessed: DataFrame, limit: int = 20) -> DataFrame:
    return assessed.orderBy(
        level_rank(F.col("risk_level")).desc(),
        F.col("ml_anomaly_percentile").desc_nulls_last(),
        F.col("rule_flag_count").desc(),
        "mmsi",
        "timestamp",
        "id",
    ).limit(limit)


def _decimals(value: Column) -> Column:
    return F.format_string("%.2f", F.floor(value * 100 + 0.5) / 100)


def risk_explanation(assessed: DataFrame) -> DataFrame:
    """Three sentences that put the evidence of one assessment into words."""
    p, count = F.col("ml_anomaly_percentile"), F.col("rule_flag_count")
    standing = (
        F.when(p >= 99.5, "extremely unusual")
        .when(p >= 99, "very unusual")
        .when(p >= 95, "unusual")
        .otherwise("not strongly unusual")
    )
    flags = F.when(count == 1, "1 rule flag").otherwise(F.concat(count.cast("string"), F.lit(" rule flags")))
    severity = F.upper(F.col("rule_severity"))
    # The sentence texts.
    model = F.concat(
        F.lit("The ML detector ranked this observation in the "),
        _decimals(p),
        F.lit("th percentile, making it "),
        standing,
        F.lit(" relative to the analyzed AIS observations."),
    )
    both = F.concat(
        F.lit("The rule engine also triggered "), flags, F.lit(" with "), severity,
        F.lit(" rule severity, so both detection methods support investigation."),
    )
    rules_only = F.concat(
        F.lit("The rule engine triggered "), flags, F.lit(" with "), severity,
        F.lit(
            " rule severity. The persisted detector-agreement flag is false, "
            "so the evidence is not confirmed by both detection methods."
        ),
    )
    model_only = F.lit(
        "No deterministic rule flags were recorded for this observation, "
        "so its investigation priority is being driven primarily by the ML-based evidence."
    )
    evidence = (
        F.when(F.col("detector_agreement") & (count > 0), both).when(count > 0, rules_only).otherwise(model_only)
    )
    closing = F.concat(
        F.lit("This observation is therefore assigned "),
        F.upper(F.col("risk_level")),
        F.lit(" investigation priority."),
    )
    return assessed.withColumn("explanation", F.concat_ws(" ", model, evidence, closing))


def split_reasons(column: Column) -> Column:
    """Reasons text as a list: a JSON string array, else text split at newline, ``;`` or ``|``."""
    trimmed = F.trim(column)
    listed = F.from_json(trimmed, "array<string>", {"mode": "PERMISSIVE"})
    is_list = trimmed.rlike(r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$')

    def humanize(reason: Column) -> Column:
        cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reason), "_", " "), r"\s+", " "))
        return F.concat(F.upper(F.substring(cleaned, 1, 1)), F.substring(cleaned, 2, 1 << 30))

    parts = F.filter(F.transform(F.split(trimmed, r"\n+|;\s*|\|\s*"), humanize), lambda r: r != "")
    return F.when(is_list, F.transform(listed, humanize)).otherwise(parts)
