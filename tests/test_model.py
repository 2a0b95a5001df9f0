import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.operators import hybrid, iforest, ranking
from fairlead.schema import MODEL_FEATURES, RULE_NAMES


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({c: rng.normal(10, 1, 200) for c in MODEL_FEATURES})
    pdf["reporting_gap_minutes"] = rng.uniform(1, 5, 200)
    pdf["id"] = np.arange(200)
    odd = pdf.iloc[[0]].assign(id=999, calculated_speed_knots=500.0, speed_difference_knots=400.0, sog=90.0, distance_nm=90.0)
    return spark.createDataFrame(pd.concat([pdf, odd]))


@pytest.fixture(scope="module")
def forest(features):
    return iforest.fit(features.filter("id < 999"), trees=50)


def test_odd_row_scores_higher(features, forest):
    scored = iforest.score(features, forest).select("id", "sog", "ml_anomaly_score", "ml_decision_function", "ml_is_anomaly").toPandas()
    assert scored["ml_anomaly_score"].between(-0.5, 0.5).all()
    assert (scored["ml_anomaly_score"] == -scored["ml_decision_function"]).all()
    assert scored.set_index("id")["ml_anomaly_score"].idxmax() == 999
    assert scored.set_index("id")["ml_is_anomaly"][999]
    assert scored.set_index("id")["sog"][999] == 90.0


def test_layout_does_not_matter(features, forest):
    again = iforest.fit(features.filter("id < 999").repartition(5, "sog"), trees=50)
    order = ["tree", "node"]
    pd.testing.assert_frame_equal(
        forest.nodes.orderBy(order).toPandas(), again.nodes.orderBy(order).toPandas()
    )
    assert forest.nodes.select("tree").distinct().count() == 50


def test_save_and_load_score_alike(spark, features, forest, tmp_path):
    forest.save(str(tmp_path / "forest"))
    loaded = iforest.Forest.load(spark, str(tmp_path / "forest"))
    a, b = (iforest.score(features, f).agg(F.sum("ml_anomaly_score")).first()[0] for f in (forest, loaded))
    assert a == pytest.approx(b)


def test_contamination_share(features):
    scored = iforest.fit_score(features, trees=50, contamination=0.1)
    assert scored.filter("ml_is_anomaly").count() == pytest.approx(20, abs=2)


def test_missing_values_and_errors(spark, features):
    holes = features.withColumn("turn_rate_degrees_per_minute", F.lit(None).cast("double"))
    forest = iforest.fit(holes, trees=10)
    assert "turn_rate_degrees_per_minute" not in forest.features
    assert iforest.score(holes, forest).filter("ml_anomaly_score is null").count() == 0
    with pytest.raises(ValueError, match="At least 2"):
        iforest.fit(features.limit(1))
    with pytest.raises(ValueError, match="Missing required ML feature columns: sog"):
        iforest.fit(features.drop("sog"))
    empty = features.select("id", *[F.lit(None).cast("double").alias(c) for c in MODEL_FEATURES])
    with pytest.raises(ValueError, match="missing"):
        iforest.fit(empty)


def test_context_mask(spark):
    base = {c: 1.0 for c in MODEL_FEATURES}
    rows = [(1, {**base, "sog": 10.0}), (2, {**base, "sog": 1.0}), (3, {**base, "reporting_gap_minutes": 11.0}), (4, {**base, "sog": float("inf")})]
    df = spark.createDataFrame([(i, *[r[c] for c in MODEL_FEATURES]) for i, r in rows], ["id", *MODEL_FEATURES])
    got = {r.id: r for r in iforest.context_mask(df).collect()}
    assert got[1].turn_rate_degrees_per_minute == 1.0
    assert got[2].turn_rate_degrees_per_minute is None and got[2].distance_nm == 1.0
    assert got[3].distance_nm is None and got[3].sog == 1.0
    assert got[4].sog is None and got[4].course_change_degrees is None


def test_average_path():
    assert iforest.average_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(iforest.average_path(256)) == pytest.approx(10.2448, abs=1e-3)


@pytest.mark.parametrize("rows", [7, 5000])
def test_quantiles_equal_numpy(spark, rows):
    rng = np.random.default_rng(rows)
    pdf = pd.DataFrame({"a": rng.normal(size=rows), "b": rng.integers(0, 3, rows).astype(float)})
    pdf.loc[pdf.index[::3], "a"] = 0.25  # a third of all rows share one value
    ps = [0.0, 0.02, 0.5, 0.75, 0.995, 1.0]
    got = ranking.exact_quantiles(spark.createDataFrame(pdf).repartition(6), ["a", "b"], ps)
    for c in "ab":
        assert got[c] == pytest.approx(np.quantile(pdf[c], ps).tolist())


def test_quantiles_of_nothing(spark):
    assert ranking.exact_quantiles(spark.createDataFrame([(None,)], "a double"), ["a"], [0.5]) == {"a": [None]}


def test_percentile_equals_searchsorted(spark):
    rng = np.random.default_rng(1)
    reference = np.round(rng.normal(size=3000), 2)
    reference[::3] = 0.5  # a hot score
    probes = np.concatenate([np.round(rng.normal(size=500), 2), np.full(400, 0.5), [-99.0, 99.0]])
    ref = ranking.fit_reference(spark.createDataFrame(pd.DataFrame({"ml_anomaly_score": reference})))
    pdf = pd.DataFrame({"id": np.arange(len(probes)), "ml_anomaly_score": probes})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(9999, None)], "id long, ml_anomaly_score double"))
    got = ranking.with_percentile(df, ref, rows_per_task=50).toPandas().set_index("id")["ml_anomaly_percentile"].sort_index()
    want = 100.0 * np.searchsorted(np.sort(reference), probes, side="right") / len(reference)
    assert len(got) == len(probes) + 1
    assert np.allclose(got.loc[: len(probes) - 1], want)
    assert np.isnan(got.loc[9999])


def test_scores_outside_the_reference_are_spread(spark):
    reference = ranking.fit_reference(spark.range(1000).select(F.col("id").cast("double").alias("ml_anomaly_score")))
    drifted = spark.range(2000).select("id", (F.col("id") + 5000.5).alias("ml_anomaly_score"))
    got = ranking.with_percentile(drifted, reference, rows_per_task=200)
    assert got.filter("ml_anomaly_percentile = 100").count() == 2000
    both = reference.counts.unionByName(drifted.select(F.col("ml_anomaly_score").alias("score"), F.lit(0).alias("n")))
    ranges = ranking._ranged(both, 200).filter("score > 5000").groupBy("bucket").count().collect()
    assert len(ranges) >= 8 and max(r["count"] for r in ranges) < 500


def test_training_pool_has_no_size_switch(spark):
    # Equal row ids hash alike; the pool must still be full.
    rows = spark.range(3000).select(F.lit(7).alias("id"), F.col("id").alias("v"))
    assert iforest._training_pool(rows, 100, 42, "id").count() == 100


def test_reference_round_trip_and_errors(spark, tmp_path):
    df = spark.createDataFrame([(float(i),) for i in range(1, 201)] + [(None,), (float("inf"),), (float("nan"),)], "ml_anomaly_score double")
    reference = ranking.fit_reference(df)
    assert reference.total == 200
    reference.save(str(tmp_path / "ref"))
    loaded = ranking.ScoreReference.load(spark, str(tmp_path / "ref"))
    probe = spark.createDataFrame([(1, 100.0)], "id long, ml_anomaly_score double")
    assert ranking.with_percentile(probe, loaded).first().ml_anomaly_percentile == 50.0
    with pytest.raises(ValueError, match="No valid"):
        ranking.fit_reference(spark.createDataFrame([(None,)], "ml_anomaly_score double"))
    with pytest.raises(ValueError, match="must contain"):
        ranking.fit_reference(probe.drop("ml_anomaly_score"))


@pytest.mark.parametrize(
    "score,flags,level,severity,agreement",
    [
        (20.0, [], "low", "none", False),
        (20.0, ["reporting_gap"], "medium", "warning", False),
        (20.0, ["speed_mismatch"], "high", "high", False),
        (20.0, ["position_jump"], "critical", "critical", False),
        (200.0, [], "high", "none", False),
        (199.0, ["reporting_gap", "rapid_course_change"], "critical", "warning", True),
        (191.0, [], "medium", "none", False),
        (197.0, ["reporting_gap"], "high", "warning", True),
        (200.0, ["extreme_acceleration"], "critical", "high", True),
    ],
)
def test_priority_levels(spark, score, flags, level, severity, agreement):
    reference = _reference(spark)
    row = {f"flag_{n}": n in flags for n in RULE_NAMES} | {"id": 1, "ml_anomaly_score": score}
    got = hybrid.assess(spark.createDataFrame([row]), reference).first()
    assert (got.risk_level, got.rule_severity, got.detector_agreement) == (level, severity, agreement)
    assert got.rule_flag_count == len(flags)
    if score == 20.0 and not flags:
        assert got.risk_reasons == "no_elevated_evidence"
    if score == 199.0:
        assert got.risk_reasons == "rules=reporting_gap,rapid_course_change; ml_percentile=99.50"


_cache = {}


def _reference(spark):
    if "r" not in _cache:
        _cache["r"] = ranking.fit_reference(spark.range(1, 201).select(F.col("id").cast("double").alias("ml_anomaly_score")))
    return _cache["r"]


def test_missing_rule_column(spark):
    with pytest.raises(ValueError, match="flag_reporting_gap"):
        hybrid.assess(spark.createDataFrame([(1, 1.0)], "id long, ml_anomaly_score double"), _reference(spark))


def test_split_reasons(spark):
    texts = ['["a_b", "c  d"]', "x_y; z|w\n\nlast", "", '["unclosed', "[1, 2]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.r for r in df.select("i", hybrid.split_reasons(F.col("t")).alias("r")).orderBy("i").collect()]
    assert got == [["A b", "C d"], ["X y", "Z", "W", "Last"], [], ['["unclosed'], ["[1, 2]"]]


def test_training_pool_is_cut_by_hash(spark):
    """The same rows for any partitioning, and the tasks hand over little more than the pool."""
    rows = spark.range(200_000)
    pools = [
        {r.id for r in iforest._training_pool(rows.repartition(n), 1000, 42, "id").select("id").collect()} for n in (3, 40)
    ]
    assert pools[0] == pools[1] and len(pools[0]) == 1000
    exact = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(42), "id"), 1)).orderBy("h", "id").limit(1000)
    assert {r.id for r in exact.collect()} == pools[0]
    pool = iforest._training_pool(rows.repartition(40), 1000, 42, "id", total=200_000)
    cut = pool._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in cut and "_mix" in cut
    # A wrong count only costs another look.
    assert iforest._training_pool(rows, 1000, 42, "id", total=100_000_000).count() == 1000


def test_a_filter_on_the_score_scores_once(features, forest):
    scored = iforest.score(features, forest).select("ml_anomaly_score").filter("ml_anomaly_score is not null")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and scored.count() == 201


def test_scores_shared_by_many_rows_are_not_joined_by_a_shuffle_of_their_own(spark):
    reference = ranking.fit_reference(spark.range(100).select(F.col("id").cast("double").alias("ml_anomaly_score")))
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, 7.0).otherwise(F.col("id")).cast("double").alias("ml_anomaly_score"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ranking.with_percentile(rows, reference, rows_per_task=50)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and got.filter("id < 900 and ml_anomaly_percentile = 8").count() == 900
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_model_runs_once_for_its_assessment(spark, monkeypatch):
    """Reference, ranks and rows read one stored copy of the scores, without the motion features."""
    from fairlead import catalog
    from fairlead.catalog import priority

    seen, assess = [], hybrid.fit_assess
    monkeypatch.setattr(priority.hybrid, "fit_assess", lambda df: seen.append(df) or assess(df))
    catalog.QUERIES["hybrid_assess_model"](spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "distance_nm" not in seen[0].columns
