"""Queries of the model, the hybrid priority and the score analyses.

The oracle-checked ones use ``value`` of the event row as stand-in score, so that
percentiles and levels are plain SQL; the forest itself is checked by rows and by
the invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.catalog import oracle_base as o
from fairlead.catalog.oracle_base import d, r, rs
from fairlead.catalog.registry import query
from fairlead.operators import comparison, hybrid, iforest, linking, ranking
from fairlead.plans import playback
from fairlead.schema import MODEL_FEATURES, RISK_LEVELS, RULE_NAMES, RULE_SEVERITIES
from fairlead.session import cut_lineage

_MASK = f"""
masked AS (
  SELECT feat.* REPLACE (
    {', '.join(f"CASE WHEN reporting_gap_minutes > 0 AND reporting_gap_minutes <= 10 {'AND sog >= 3' if c in iforest.TURN_FEATURES else ''} THEN {c} END AS {c}" for c in iforest.MOTION_FEATURES)})
  FROM feat)"""


@query("ml_context_mask", o.sql(f"SELECT id, {rs(*MODEL_FEATURES)} FROM masked", *o.TO_FEAT, _MASK))
def _(w):
    return iforest.context_mask(w.annotated()).select("id", *MODEL_FEATURES)


_MEDIANS = ", ".join(f"(SELECT quantile_cont({c}, 0.5) FROM masked) AS m_{c}" for c in MODEL_FEATURES)


@query(
    "median_impute",
    o.sql(f"SELECT id, {', '.join(r(f'coalesce({c}, m_{c})', c) for c in MODEL_FEATURES)} FROM masked, (SELECT {_MEDIANS})", *o.TO_FEAT, _MASK),
)
def _(w):
    masked = iforest.context_mask(w.annotated())
    return iforest.impute(masked, iforest.feature_medians(masked)).select("id", *MODEL_FEATURES)


@query(
    "iforest_fit",
    o.sql("SELECT unnest(range(200)) AS tree, (SELECT least(256, count(*)) FROM clean) AS leaf_rows, TRUE AS depth_holds, TRUE AS nodes_hold", *o.TO_CLEAN),
)
def _(w):
    """Per tree: rows of all leaves, the depth limit, and one leaf more than inner nodes."""
    leaf = F.col("child") == F.col("node")
    rows = F.sum(F.when(leaf, F.col("rows")))
    limit = F.ceil(F.log2(F.greatest(rows, F.lit(2))))
    return iforest.fit(w.annotated()).nodes.groupBy("tree").agg(
        rows.alias("leaf_rows"), (F.max("depth") <= limit).alias("depth_holds"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("nodes_hold"),
    )


def _scored(w):
    if "forest" not in w._tables:
        w._tables["forest"] = iforest.fit(w.annotated())
    return iforest.score(w.annotated(), w._tables["forest"])


@query("iforest_score", o.sql("SELECT id, mmsi, TRUE AS verdict_holds, TRUE AS score_holds, TRUE AS in_range FROM clean", *o.TO_CLEAN))
def _(w):
    """Every report is scored; verdict and score follow from the decision, whose raw value is in [-1, 0)."""
    decision = F.col("ml_decision_function")
    return _scored(w).select(
        "id", "mmsi", (F.col("ml_is_anomaly") == (decision < 0)).alias("verdict_holds"),
        (F.col("ml_anomaly_score") == -decision).alias("score_holds"),
        decision.between(-0.5, 0.5).alias("in_range"),
    )


@query("iforest_fit_score", o.sql("SELECT count(*) AS reports, TRUE AS share_holds FROM clean", *o.TO_CLEAN))
def _(w):
    """A contamination of 2 % marks that share, but for ties at the cut-off."""
    scored = cut_lineage(iforest.fit_score(w.annotated(), contamination=0.02).select("ml_decision_function", "ml_is_anomaly"))
    share = 0.02 * F.count(F.lit(1))
    return scored.agg(
        F.count(F.lit(1)).alias("reports"),
        ((F.count_if("ml_is_anomaly") <= F.ceil(share)) & (F.count_if(F.col("ml_decision_function") <= 0) >= F.floor(share))).alias("share_holds"),
    )


@query(
    "hybrid_assess_model",
    o.sql("SELECT id, mmsi, CAST(rule_flag_count AS BIGINT) AS rule_flag_count, rule_severity, TRUE AS percentile_holds, TRUE AS level_holds FROM pct", *o.TO_RISK),
)
def _(w):
    """Model scores end to end: the percentile is each score's rank, the level follows from percentile and rules."""
    # Reference, ranks and rows are three readers: the model runs once for them, and only what they read is kept.
    scored = cut_lineage(_scored(w).select("id", "mmsi", "ml_anomaly_score", *hybrid.FLAGS))
    assessed = cut_lineage(hybrid.fit_assess(scored))
    total = assessed.agg(F.count(F.lit(1))).scalar()
    scores = assessed.groupBy("ml_anomaly_score").agg(F.count(F.lit(1)).alias("n"), F.min("ml_anomaly_percentile").alias("low"), F.max("ml_anomaly_percentile").alias("high"))
    steps = ranking.cumulative_counts(
        scores.withColumn("_range", F.floor(F.col("ml_anomaly_score") * 1000)), [], "ml_anomaly_score", "_range"
    )
    exact = F.col("rank") * 100.0 / total
    close = (F.abs(F.col("low") - exact) < 1e-9) & (F.abs(F.col("high") - exact) < 1e-9)
    again = hybrid.risk_level(assessed.drop("risk_level", "detector_agreement")).select("id", F.col("risk_level").alias("again"))
    return (
        assessed.join(steps.select("ml_anomaly_score", close.alias("percentile_holds")), "ml_anomaly_score")
        .join(again, "id")
        .select("id", "mmsi", F.col("rule_flag_count").cast("bigint").alias("rule_flag_count"), "rule_severity",
                "percentile_holds", (F.col("risk_level") == F.col("again")).alias("level_holds"))
    )


@query("score_percentile", o.sql(f"SELECT id, {rs('ml_anomaly_score', 'ml_anomaly_percentile')} FROM pct", *o.TO_RISK))
def _(w):
    scores = w.messages().select("id", "ml_anomaly_score")
    return ranking.with_percentile(scores, ranking.fit_reference(scores))


@query("rule_severity", o.sql("SELECT id, CAST(rule_flag_count AS BIGINT) AS rule_flag_count, rule_severity FROM pct", *o.TO_RISK))
def _(w):
    return hybrid.rule_severity(hybrid.normalize_flags(w.annotated())).select("id", "rule_flag_count", "rule_severity")


@query("hybrid_risk_level", o.sql("SELECT message_id, risk_level, detector_agreement FROM risk", *o.TO_RISK))
def _(w):
    return hybrid.risk_level(w.assessed().drop("risk_level", "detector_agreement")).select(
        F.col("id").alias("message_id"), "risk_level", "detector_agreement"
    )


@query("risk_reasons", o.sql("SELECT message_id, risk_reasons FROM risk", *o.TO_RISK))
def _(w):
    return hybrid.risk_reasons(w.assessed().drop("risk_reasons")).select(F.col("id").alias("message_id"), "risk_reasons")


RISK_OUT = (
    "message_id, mmsi, us AS timestamp, " + rs("ml_anomaly_score", "ml_anomaly_percentile")
    + ", CAST(rule_flag_count AS BIGINT) AS rule_flag_count, rule_severity, detector_agreement, risk_level, risk_reasons"
)
RISK_COLUMNS = (
    "message_id", "mmsi", "timestamp", "ml_anomaly_score", "ml_anomaly_percentile", "rule_flag_count", "rule_severity",
    "detector_agreement", "risk_level", "risk_reasons",
)


@query("hybrid_assess", o.sql(f"SELECT {RISK_OUT} FROM risk", *o.TO_RISK))
def _(w):
    return hybrid.fit_assess(w.annotated()).withColumnRenamed("id", "message_id").select(*RISK_COLUMNS)


_DAY = """
refday AS (SELECT us // 86400000000 AS day, count(*) AS observations FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@query("reference_day", o.sql("SELECT day * 86400000000 AS day, observations FROM refday", *o.TO_CLEAN, _DAY))
def _(w):
    return playback.reference_day(w.messages())


@query(
    "stable_baseline",
    o.sql(
        f"""SELECT m.id, {r(f'{d(100)} * (SELECT count(*) FROM base b WHERE b.ml_anomaly_score <= m.ml_anomaly_score) / (SELECT count(*) FROM base)', 'ml_anomaly_percentile')}
        FROM ann m WHERE us // 86400000000 <> (SELECT day FROM refday)""",
        *o.TO_ANN, _DAY, "\nbase AS (SELECT * FROM ann WHERE us // 86400000000 = (SELECT day FROM refday))",
    ),
)
def _(w):
    """Reports of other days placed in the distribution of the reference day."""
    base = playback.on_reference_day(w.annotated())
    reference = ranking.fit_reference(base)
    later = w.annotated().join(base.select("id"), "id", "left_anti")
    return ranking.with_percentile(later, reference).select("id", "ml_anomaly_percentile")


# The stand-in model verdict: the top of the score range.
_VERDICT = "\nver AS (SELECT *, ml_anomaly_score > 30 AS ml, has_anomaly AS ru FROM ann)"


def _compared(w):
    return comparison.with_verdicts(w.annotated().withColumn("ml_is_anomaly", F.col("ml_anomaly_score") > 30))


@query(
    "ml_rule_contingency",
    o.sql(
        f"""SELECT count(*) AS observations, count(*) FILTER (WHERE ml) AS ml_anomalies, count(*) FILTER (WHERE ru) AS rule_anomalies,
        count(*) FILTER (WHERE ml AND ru) AS both, count(*) FILTER (WHERE ml AND NOT ru) AS ml_only,
        count(*) FILTER (WHERE NOT ml AND ru) AS rules_only, count(*) FILTER (WHERE NOT ml AND NOT ru) AS neither,
        {r(f'{d(100)} * count(*) FILTER (WHERE ml AND ru) / count(*) FILTER (WHERE ml)', 'ml_also_rules_percent')},
        {', '.join(f'count(*) FILTER (WHERE flag_{n}) AS rule_{n}' for n in RULE_NAMES)} FROM ver""",
        *o.TO_ANN, _VERDICT,
    ),
)
def _(w):
    return comparison.contingency(_compared(w))


@query(
    "ml_rule_examples",
    o.sql(
        f"""SELECT class, class_rank, id, mmsi, us AS timestamp, {r('ml_anomaly_score')} FROM (
          SELECT *, row_number() OVER (PARTITION BY class ORDER BY ml_anomaly_score DESC, id) AS class_rank FROM (
            SELECT *, CASE WHEN ml AND ru THEN 'both' WHEN ml THEN 'ml_only' WHEN ru THEN 'rules_only' END AS class FROM ver)
          WHERE class IS NOT NULL) WHERE class_rank <= 10""",
        *o.TO_ANN, _VERDICT,
    ),
)
def _(w):
    return comparison.examples(_compared(w)).select("class", "class_rank", "id", "mmsi", "timestamp", "ml_anomaly_score")


_TAILS = "\ntails AS (SELECT unnest([10.0, 5.0, 2.0, 1.0, 0.5]) AS p)"


@query(
    "score_tail_analysis",
    o.sql(
        f"""SELECT {r('p', 'top_percent')}, {r('t', 'threshold')}, count(*) AS selected_rows,
        {r(f'{d(100)} * count(*) FILTER (WHERE ru) / count(*)', 'rule_overlap_percent')}
        FROM (SELECT p, (SELECT quantile_cont(ml_anomaly_score, [0.9, 0.95, 0.98, 0.99, 0.995]) FROM ver)[i] AS t
              FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS i FROM tails)) JOIN ver ON ml_anomaly_score >= t GROUP BY p, t""",
        *o.TO_ANN, _VERDICT, _TAILS,
    ),
)
def _(w):
    return comparison.score_tails(_compared(w))


_P = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p99_5": 0.995}


@query(
    "score_distribution",
    o.sql(
        f"""SELECT count(ml_anomaly_score) AS count, {r('avg(ml_anomaly_score)', 'mean')}, {r('stddev_samp(ml_anomaly_score)', 'std')},
        {r('min(ml_anomaly_score)', 'min')}, {r('max(ml_anomaly_score)', 'max')},
        {', '.join(r(f'quantile_cont(ml_anomaly_score, {p})', n) for n, p in _P.items())} FROM ann""",
        *o.TO_ANN,
    ),
)
def _(w):
    return comparison.score_distribution(w.annotated())


@query(
    "context_diagnostics",
    o.sql(
        """SELECT count(*) FILTER (WHERE ml AND reporting_gap_minutes > 15) AS ml_long_gap,
        count(*) FILTER (WHERE ru AND reporting_gap_minutes > 15) AS rule_long_gap,
        count(*) FILTER (WHERE ru AND NOT ml AND sog < 3) AS rule_only_slow,
        count(*) FILTER (WHERE ru AND NOT ml AND sog < 3 AND course_change_degrees > 90) AS rule_only_slow_large_turn FROM ver""",
        *o.TO_ANN, _VERDICT,
    ),
)
def _(w):
    return comparison.context_diagnostics(_compared(w))


def _distribution_sql() -> str:
    values = [("level", "risk_level", v) for v in RISK_LEVELS] + [("severity", "rule_severity", v) for v in RULE_SEVERITIES]
    return "\nUNION ALL ".join(
        f"SELECT '{k}' AS kind, '{v}' AS value, count(*) FILTER (WHERE {c} = '{v}') AS rows, "
        + r(f"{d(100)} * count(*) FILTER (WHERE {c} = '{v}') / count(*)", "percent") + " FROM risk"
        for k, c, v in values
    )


@query("risk_distribution", o.sql(_distribution_sql(), *o.TO_RISK))
def _(w):
    return hybrid.risk_distribution(w.assessed())


RANK = "CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(
    "top_risk_observations",
    o.sql(f"SELECT {RISK_OUT} FROM risk ORDER BY {RANK} DESC, risk.ml_anomaly_percentile DESC, risk.rule_flag_count DESC, mmsi, us, id LIMIT 20", *o.TO_RISK),
)
def _(w):
    return hybrid.top_risk_observations(w.assessed()).withColumnRenamed("id", "message_id").select(*RISK_COLUMNS)


@query("top_ml_observations", o.sql(f"SELECT id, mmsi, {r('ml_anomaly_score')} FROM clean ORDER BY clean.ml_anomaly_score DESC, id LIMIT 10", *o.TO_CLEAN))
def _(w):
    return comparison.top_scores(w.messages()).select("id", "mmsi", "ml_anomaly_score")


_EXPLAIN = f"""
'The ML detector ranked this observation in the ' || {o.two('ml_anomaly_percentile')} || 'th percentile, making it ' ||
CASE WHEN ml_anomaly_percentile >= 99.5 THEN 'extremely unusual' WHEN ml_anomaly_percentile >= 99 THEN 'very unusual'
     WHEN ml_anomaly_percentile >= 95 THEN 'unusual' ELSE 'not strongly unusual' END ||
' relative to the analyzed AIS observations. ' ||
CASE WHEN rule_flag_count = 0 THEN 'No deterministic rule flags were recorded for this observation, so its investigation priority is being driven primarily by the ML-based evidence.'
     ELSE CASE WHEN detector_agreement THEN 'The rule engine also triggered ' ELSE 'The rule engine triggered ' END ||
          CASE WHEN rule_flag_count = 1 THEN '1 rule flag' ELSE rule_flag_count || ' rule flags' END || ' with ' || upper(rule_severity) ||
          CASE WHEN detector_agreement THEN ' rule severity, so both detection methods support investigation.'
               ELSE ' rule severity. The persisted detector-agreement flag is false, so the evidence is not confirmed by both detection methods.' END
     END || ' This observation is therefore assigned ' || upper(risk_level) || ' investigation priority.'"""


@query("risk_explanation", o.sql(f"SELECT message_id, {_EXPLAIN} AS explanation FROM risk", *o.TO_RISK))
def _(w):
    return hybrid.risk_explanation(w.risks()).select("message_id", "explanation")


@query(
    "split_reasons",
    o.sql(
        """SELECT message_id, CASE WHEN risk_reasons = 'no_elevated_evidence' THEN 'No elevated evidence'
          ELSE array_to_string(list_transform(string_split(risk_reasons, '; '), lambda x: upper(left(replace(x, '_', ' '), 1)) || substr(replace(x, '_', ' '), 2)), '|')
          END AS reasons FROM risk""",
        *o.TO_RISK,
    ),
)
def _(w):
    """Half of the rows carry their reasons as a JSON list, the rest as text."""
    text = F.col("risk_reasons")
    as_json = F.to_json(F.split(text, "; "))
    return w.risks().select(
        "message_id", hybrid.split_reasons(F.when(F.col("message_id") % 8 == 0, as_json).otherwise(text)).alias("reasons")
    )


# --- imported tables -----------------------------------------------------------

# Text round trip of alerts and assessments with every tenth row spoiled.
_ALERT_TEXT = """
atext AS (SELECT message_id, mmsi || '.0' AS mmsi, us, latitude, longitude, anomaly_type,
  CASE WHEN message_id % 10 = 0 THEN '  ' ELSE ' ' || severity END AS severity FROM alerts)"""


@query(
    "alert_validate",
    o.sql("SELECT message_id, anomaly_type, left(mmsi, 9) AS mmsi, nullif(trim(severity), '') AS severity, trim(severity) <> '' AS usable FROM atext", *o.TO_ALERTS, _ALERT_TEXT),
)
def _(w):
    spoiled = w.alerts().withColumns(
        {
            "mmsi": F.concat("mmsi", F.lit(".0")),
            "severity": F.when(F.col("message_id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "severity")),
        }
    )
    good, bad = linking.alert_validate(spoiled)
    columns = ["message_id", "anomaly_type", "mmsi", "severity"]
    return good.select(*columns, F.lit(True).alias("usable")).unionByName(bad.select(*columns, F.lit(False).alias("usable")))


@query(
    "risk_validate",
    o.sql(
        """SELECT message_id, risk_level = 'medium' AND message_id % 3 = 0 OR message_id % 7 = 0 AS broken, rule_severity FROM risk""",
        *o.TO_RISK,
    ),
)
def _(w):
    odd = w.risks().withColumns(
        {
            "risk_level": F.when((F.col("risk_level") == "medium") & (F.col("message_id") % 3 == 0), "severe").otherwise(
                F.upper("risk_level")
            ),
            "ml_anomaly_percentile": F.when(F.col("message_id") % 7 == 0, 101.0).otherwise(F.col("ml_anomaly_percentile")),
        }
    )
    good, bad = linking.risk_validate(odd)
    return good.select("message_id", F.lit(False).alias("broken"), "rule_severity").unionByName(
        bad.select("message_id", F.lit(True).alias("broken"), "rule_severity")
    )


@query(
    "vessel_dim",
    o.sql("SELECT mmsi, vessel_name, vessel_type, first_seen, last_seen FROM vessels", *o.TO_CLEAN, o.VESSELS),
)
def _(w):
    return linking.vessel_dim(w.messages()).select("mmsi", "vessel_name", "vessel_type", "first_seen", "last_seen")


# A second delivery: the reports of the second day.
_BATCH = f"\nbatch AS (SELECT * FROM clean WHERE us >= {o.ORIGIN + 86_400_000_000})"
_SPLIT_DAY = "timestamp '2024-01-02 00:00:00'"


def _batch(w):
    return w.messages().filter(F.col("timestamp") >= F.expr(_SPLIT_DAY))


def _before(w):
    return w.messages().filter(F.col("timestamp") < F.expr(_SPLIT_DAY))


@query(
    "sink_upsert_coalesce",
    o.sql(
        f"""SELECT mmsi, coalesce(max_by(vessel_name, ord) FILTER (WHERE vessel_name IS NOT NULL AND us >= {o.ORIGIN + 86_400_000_000}),
             max_by(vessel_name, ord) FILTER (WHERE vessel_name IS NOT NULL)) AS vessel_name, min(us) AS first_seen, max(us) AS last_seen
           FROM clean GROUP BY mmsi""",
        *o.TO_CLEAN,
    ),
)
def _(w):
    merged = linking.merge_vessels(linking.vessel_dim(_before(w)), linking.vessel_dim(_batch(w)))
    return merged.select("mmsi", "vessel_name", "first_seen", "last_seen")


@query("sink_upsert_ignore", o.sql("SELECT id FROM clean WHERE us >= (SELECT min(us) FROM batch)", *o.TO_CLEAN, _BATCH))
def _(w):
    from fairlead.sources.tables import upsert_ignore

    keys = linking.MESSAGE_KEY
    offered = w.standardized().filter("is_valid_core_record").select("id", *keys)
    return upsert_ignore(_before(w).select("id", *keys), offered, keys, "id").select("id")


@query(
    "sink_upsert_update",
    o.sql(
        f"""SELECT message_id, CASE WHEN us >= (SELECT min(us) FROM batch) THEN 'v2' ELSE 'v1' END AS assessment_version,
        {r('ml_anomaly_percentile')} FROM risk""",
        *o.TO_RISK, _BATCH,
    ),
)
def _(w):
    from fairlead.sources.tables import upsert_replace

    columns = ["message_id", "ml_anomaly_percentile"]
    stored = w.risks().select(*columns, F.lit("v1").alias("assessment_version"))
    newer = w.risks().filter(F.col("timestamp") >= F.expr(_SPLIT_DAY)).select(*columns, F.lit("v2").alias("assessment_version"))
    return upsert_replace(stored, newer, ("message_id",), "message_id")


@query("link_alerts", o.sql("SELECT message_id AS found_id, anomaly_type FROM alerts", *o.TO_ALERTS))
def _(w):
    linked = linking.link_alerts(w.alerts().drop("message_id"), w.messages())
    return linked.select(F.col("message_id").alias("found_id"), "anomaly_type")


@query(
    "link_risk",
    o.sql("SELECT r.message_id, m.found AS found_id FROM risk r LEFT JOIN (SELECT mmsi, us, max(id) AS found FROM clean GROUP BY 1, 2) m USING (mmsi, us)", *o.TO_RISK),
)
def _(w):
    linked = linking.link_risk(w.risks().withColumnRenamed("message_id", "own"), w.messages())
    return linked.select(F.col("own").alias("message_id"), F.col("message_id").alias("found_id"))


@query(
    "link_alerts_partly",
    o.sql("SELECT message_id AS found_id, anomaly_type FROM alerts WHERE us >= (SELECT min(us) FROM batch) "
          "UNION ALL SELECT NULL, anomaly_type FROM alerts WHERE us < (SELECT min(us) FROM batch)", *o.TO_ALERTS, _BATCH),
)
def _(w):
    """Alerts of reports that are not stored stay without a message."""
    linked = linking.link_alerts(w.alerts().drop("message_id"), _batch(w))
    return linked.select(F.col("message_id").alias("found_id"), "anomaly_type")


@query(
    "import_validate_counts",
    o.sql(
        f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE is_valid_core_record) - count(*) FILTER (WHERE is_valid_core_record AND duplicate_record) AS rows_imported,
        count(*) FILTER (WHERE NOT is_valid_core_record) AS rows_rejected, count(*) FILTER (WHERE is_valid_core_record AND duplicate_record) AS duplicates_skipped FROM std""",
        *o.BASE,
    ),
)
def _(w):
    good, bad = linking.import_validate(w.raw())
    keyed = good.groupBy(*linking.MESSAGE_KEY).agg(F.count(F.lit(1)).alias("copies"))
    counted = keyed.agg(F.sum("copies").alias("valid"), F.count(F.lit(1)).alias("rows_imported"))
    return counted.crossJoin(bad.agg(F.count(F.lit(1)).alias("rows_rejected"))).select(
        (F.col("valid") + F.col("rows_rejected")).alias("rows_read"),
        "rows_imported",
        "rows_rejected",
        (F.col("valid") - F.col("rows_imported")).alias("duplicates_skipped"),
    )


@query("incoming_keys", o.sql("SELECT DISTINCT mmsi, us AS timestamp FROM raw WHERE us IS NOT NULL AND mmsi <> 'BAD'", o.RAW))
def _(w):
    return linking.incoming_keys(w.raw())


# Incremental view: the batch is the last twelve hours of the first day.
_RECENT = f"\nrecent AS (SELECT * FROM clean WHERE us >= {o.ORIGIN + 43_200_000_000} AND us < {o.ORIGIN + 86_400_000_000})"


def _recent_keys(w):
    inside = (F.col("timestamp") >= F.expr("timestamp '2024-01-01 12:00:00'")) & (F.col("timestamp") < F.expr(_SPLIT_DAY))
    return linking.incoming_keys(w.messages().filter(inside))


@query(
    "affected_history",
    o.sql("SELECT id FROM clean WHERE mmsi IN (SELECT mmsi FROM recent) AND us <= (SELECT max(us) FROM recent)", *o.TO_CLEAN, _RECENT),
)
def _(w):
    return linking.affected_history(w.messages(), _recent_keys(w)).select("id")


@query(
    "restrict_to_incoming",
    o.sql("SELECT message_id, anomaly_type FROM alerts WHERE (mmsi, us) IN (SELECT (mmsi, us) FROM recent)", *o.TO_ALERTS, _RECENT),
)
def _(w):
    return linking.restrict_to_incoming(w.alerts(), _recent_keys(w)).select("message_id", "anomaly_type")
