import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.config import ApproachThresholds
from fairlead.operators import encounters

STATE = "mmsi string, latitude double, longitude double, sog double, cog double"
PAIR = ", ".join(f"{s}_{c} double" for s in "ab" for c in ("latitude", "longitude", "sog", "cog"))


def vessels(spark, rows):
    return spark.createDataFrame(rows, STATE)


def approach(spark, a, b):
    return encounters.closest_approach(spark.createDataFrame([(*a, *b)], PAIR)).first()


def test_head_on(spark):
    got = approach(spark, (0.0, 0.0, 10.0, 90.0), (0.0, 0.1, 10.0, 270.0))
    assert got.current_distance_nm == pytest.approx(6.0)
    assert got.tcpa_minutes == pytest.approx(18.0) and got.cpa_distance_nm == pytest.approx(0.0, abs=1e-9)
    assert got.is_closing and got.bearing_from_a_to_b_degrees == pytest.approx(90.0)


def test_crossing(spark):
    got = approach(spark, (0.0, 0.0, 10.0, 90.0), (0.1, 0.1, 10.0, 180.0))
    assert got.current_distance_nm == pytest.approx(8.485, abs=1e-3) and got.tcpa_minutes == pytest.approx(36.0, abs=0.01)


def test_diverging_and_parallel(spark):
    got = approach(spark, (0.0, 0.0, 10.0, 270.0), (0.0, 0.1, 10.0, 90.0))
    assert got.tcpa_minutes == pytest.approx(-18.0) and got.future_cpa_distance_nm == pytest.approx(6.0) and not got.is_closing
    same = approach(spark, (0.0, 0.0, 10.0, 90.0), (0.0, 0.1, 10.0, 90.0))
    assert same.tcpa_minutes is None and same.relative_speed_knots == 0.0 and same.cpa_distance_nm == pytest.approx(6.0)
    twin = approach(spark, (0.0, 0.0, 10.0, 90.0), (0.0, 0.0, 5.0, 90.0))
    assert twin.bearing_from_a_to_b_degrees == 0.0 and twin.closing_speed_knots == 0.0


RISK = "current_distance_nm double, future_cpa_distance_nm double, tcpa_minutes double, closing_speed_knots double, is_closing boolean"


@pytest.mark.parametrize(
    "row,level,reason",
    [
        ((5.0, 0.2, 10.0, 12.345, True), "critical", "12.35 knots"),
        ((5.0, 0.4, 20.0, 9.0, True), "high", "within 0.50 NM"),
        ((5.0, 0.9, 40.0, 9.0, True), "medium", "within 45 minutes"),
        ((5.0, 3.0, 40.0, 9.0, True), "low", "does not meet"),
        ((5.0, 5.0, -3.0, -9.0, False), "low", "already occurred"),
        ((5.0, 5.0, None, 0.0, False), "low", "negligible"),
        ((0.2, 0.2, -3.0, -1.0, False), "critical", "critical proximity"),
        ((0.2, 0.1, 3.0, 1.0, True), "critical", "still closing"),
    ],
)
def test_levels(spark, row, level, reason):
    got = encounters.collision_risk(spark.createDataFrame([row], RISK)).first()
    assert got.risk_level == level and reason in " ".join(got.reasons)


def test_custom_limits(spark):
    limits = ApproachThresholds(critical_cpa_nm=3.5, high_cpa_nm=4.0, medium_cpa_nm=5.0, critical_tcpa_minutes=41.0, high_tcpa_minutes=42.0)
    row = spark.createDataFrame([(5.0, 3.0, 40.0, 9.0, True)], RISK)
    assert encounters.collision_risk(row, limits).first().risk_level == "critical"


def _distance(p, q):
    la, oa, lb, ob = map(math.radians, (*p, *q))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * 3440.065 * math.asin(math.sqrt(min(1.0, h)))


def _cloud(seed, n=260):
    rng = np.random.default_rng(seed)
    spread = [
        np.column_stack([rng.uniform(-90, 90, n // 4), rng.uniform(-180, 180, n // 4)]),
        np.column_stack([rng.choice([-1, 1], n // 4) * rng.uniform(88.5, 90, n // 4), rng.uniform(-180, 180, n // 4)]),
        np.column_stack([rng.uniform(-2, 2, n // 4), np.where(rng.random(n // 4) < 0.5, 1, -1) * rng.uniform(179, 180, n // 4)]),
        np.column_stack([rng.normal(40.5, 0.1, n // 4), rng.normal(-74, 0.1, n // 4)]),
        np.array([[90.0, 0.0], [-90.0, 10.0], [0.0, 180.0], [0.0, -180.0]]),
    ]
    return np.vstack(spread)


@pytest.mark.parametrize("radius,cell_rows", [(5.0, 20_000), (20.0, 3), (300.0, 10), (2.0, 1), (6000.0, 50)])
def test_candidates_equal_brute_force(spark, radius, cell_rows):
    points = _cloud(int(radius))
    ids = [str(200000000 + i) for i in range(len(points))]
    want = {(ids[i], ids[j]) for i in range(len(points)) for j in range(i + 1, len(points)) if _distance(points[i], points[j]) <= radius}
    df = vessels(spark, [(m, float(p[0]), float(p[1]), 1.0, 0.0) for m, p in zip(ids, points)])
    rows = encounters.encounter_candidates(df, radius, cell_rows=cell_rows).select("a_mmsi", "b_mmsi").collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == want


def test_antimeridian_and_counts(spark):
    df = vessels(spark, [("111111111", 0.0, 179.99, 5.0, 0.0), ("222222222", 0.0, -179.99, 5.0, 0.0), ("333333333", 10.0, 0.0, 5.0, 0.0)])
    assert encounters.encounter_candidates(df).count() == 1
    got = encounters.candidate_metrics(df).first()
    assert (got.vessel_count, got.possible_pair_count, got.distance_checked_pair_count, got.candidate_count) == (3, 3, 1, 1)


def test_time_gap_in_the_join(spark):
    rng = np.random.default_rng(3)
    n = 80
    pdf = pd.DataFrame({
        "mmsi": [str(300000000 + i) for i in range(n)], "id": np.arange(n),
        "timestamp": pd.to_datetime(1_704_067_200 + rng.integers(0, 3600, n), unit="s"),
        "latitude": rng.normal(40, 0.05, n), "longitude": rng.normal(-70, 0.05, n), "sog": 5.0, "cog": 10.0,
    })
    df = spark.createDataFrame(pdf)
    for gap in (0.0, 5.0):
        inside = encounters.encounter_candidates(df, 20.0, gap).select("a_mmsi", "b_mmsi").collect()
        after = encounters.pair_time_alignment(encounters.encounter_candidates(df, 20.0), gap).select("a_mmsi", "b_mmsi").collect()
        assert len(set(inside)) == len(inside) and set(inside) == set(after)


def test_bad_input(spark):
    df = vessels(spark, [("111111111", 0.0, 0.0, 5.0, 0.0), ("111111111", 0.0, 0.0, 5.0, 0.0)])
    with pytest.raises(ValueError, match="one state"):
        encounters.encounter_candidates(df)
    for radius in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            encounters.encounter_candidates(df, radius)
    for state in ((91.0, 0.0, 5.0, 0.0), (0.0, 181.0, 5.0, 0.0), (0.0, 0.0, -1.0, 0.0), (0.0, 0.0, 5.0, None)):
        bad = vessels(spark, [("111111111", *state)])
        with pytest.raises(Exception, match="unusable vessel motion"):
            encounters.encounter_candidates(bad).collect()


def test_scan_order_and_low(spark):
    rows = [("111111111", 0.0, 0.0, 10.0, 90.0), ("222222222", 0.0, 0.05, 10.0, 270.0), ("333333333", 0.02, 0.05, 0.0, 0.0)]
    hidden = encounters.by_urgency(encounters.collision_scan(vessels(spark, rows))).collect()
    shown = encounters.collision_scan(vessels(spark, rows), include_low=True).collect()
    assert hidden[0].risk_level == "critical" and "low" not in {r.risk_level for r in hidden}
    assert len(shown) == 3


def test_latest_has_no_fallback(spark):
    rows = [(1, "111111111", "2024-01-01 00:00:00", 0.0, 0.0, 5.0, 1.0), (2, "111111111", "2024-01-01 00:00:00", 0.0, 0.0, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, mmsi string, timestamp string, latitude double, longitude double, sog double, cog double").withColumn("timestamp", F.to_timestamp("timestamp"))
    latest = encounters.latest_reports(df)
    assert latest.first().id == 2 and encounters.usable_snapshot(latest).count() == 0
    assert tuple(encounters.snapshot_counts(latest).first()) == (1, 0, 1)


def test_current_window(spark):
    rows = [(1, "111111111", "2024-01-01 00:00:00"), (2, "222222222", "2024-01-01 00:00:00"), (3, "333333333", "2024-01-01 00:20:00"), (4, "444444444", "2024-01-01 00:20:00")]
    messages = spark.createDataFrame(rows, "id long, mmsi string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    stored = spark.createDataFrame([(1, 2), (3, 4), (1, 4)], "message_a long, message_b long")
    assert [tuple(r) for r in encounters.current_encounters(stored, messages).select("message_a", "message_b").collect()] == [(3, 4)]
    assert encounters.current_encounters(stored, messages, 31).count() == 3
    with pytest.raises(ValueError):
        encounters.current_encounters(stored, messages, 0)


def _snapshot(spark, n=300, seed=11):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "mmsi": [str(300000000 + i) for i in range(n)], "id": np.arange(n),
        "timestamp": pd.to_datetime(1_704_067_200 + rng.integers(0, 3600, n), unit="s"),
        "latitude": rng.normal(40, 0.08, n), "longitude": rng.normal(-70, 0.08, n),
        "sog": rng.choice([0.0, 0.0003, 12.0, 25.0], n), "cog": rng.uniform(0, 360, n),
    })
    return spark.createDataFrame(pdf)


def test_pair_blocks_are_dealt_to_all_tasks(spark):
    tasks = 4 * spark.sparkContext.defaultParallelism
    for gap in (None, 5.0):
        pairs = encounters.encounter_candidates(_snapshot(spark), 20.0, gap, cell_rows=10, check=False)
        # Few bytes: by size alone Spark would put all of them into one task.
        sizes = pairs.rdd.glom().map(len).collect()
        assert len(sizes) >= tasks and sum(n > 0 for n in sizes) > tasks / 2 and max(sizes) < sum(sizes) / 3


def test_prefilter_loses_no_elevated_pair(spark):
    df = _snapshot(spark, 400)
    keys = ("a_mmsi", "b_mmsi", "risk_level")
    for gap in (None, 5.0):
        whole = encounters.collision_scan(df, 20.0, include_low=True, max_gap_minutes=gap, check=False).filter("risk_level <> 'low'")
        few = encounters.collision_scan(df, 20.0, max_gap_minutes=gap, check=False).select(*keys).collect()
        assert len(few) > 50 and sorted(few) == sorted(whole.select(*keys).collect())


def test_changed_vessels_meet_all_others_once(spark):
    df = _snapshot(spark).withColumn("_changed", F.col("id") % 3 == 0)
    for gap in (None, 5.0):
        pairs = encounters.encounter_candidates(df, 20.0, gap, cell_rows=20, check=False, changed="_changed")
        got = pairs.select("a_id", "b_id").collect()
        every = encounters.encounter_candidates(df.drop("_changed"), 20.0, gap, check=False)
        want = every.filter("a_id % 3 = 0 or b_id % 3 = 0").select("a_id", "b_id").collect()
        assert len(got) == len(set(got)) > 0 and set(got) == set(want)


def test_counters_do_not_shuffle_all_pairs(spark):
    df = _snapshot(spark)
    stored = encounters.encounter_records(df).filter("message_a % 2 = 0")
    counters = encounters.store_counters(df, df, stored)
    plan = counters._jdf.queryExecution().executedPlan().toString()
    # Only eligible pairs are joined with the stored ones.
    assert not [step for step in plan.splitlines() if "SortMergeJoin" in step and "LeftOuter" in step]
    got, known = counters.first(), stored.count()
    assert 0 < known == got.duplicate_count and got.duplicate_count + got.inserted_count == got.eligible_encounter_count


def test_tasks_of_the_pair_step_grow_with_the_vessels(spark, monkeypatch):
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    assert encounters._tasks(spark, 0) == encounters._tasks(spark, 100) == least
    assert encounters._tasks(spark, 2_000_000) >= 2_000_000 / 1_000
    # As many tasks in the plan of the pairs, and the same pairs.
    df = _snapshot(spark, 200)
    want = sorted(encounters.encounter_candidates(df, 20.0, check=False).select("a_id", "b_id").collect())
    monkeypatch.setattr(encounters, "_tasks", lambda _, vessels: 2 * least if vessels == 200 else least)
    pairs = encounters.encounter_candidates(df, 20.0, cell_rows=10, check=False).select("a_id", "b_id")
    assert len(want) > 0 and sorted(pairs.collect()) == want
    assert pairs.rdd.getNumPartitions() == 2 * least


def test_details_look_reports_up_once_per_report_not_per_pair(spark, monkeypatch):
    from datetime import datetime

    from fairlead.functions.dates import DATE
    from fairlead.plans import search

    at = datetime(2024, 1, 1)
    pairs = [("1", "2", 11, 12), ("1", "3", 11, 13), ("2", "3", 12, 13), ("1", "9", 11, 13), ("1", "2", 11, 99), (None, "2", 11, 12)]
    found = spark.createDataFrame(
        [(a, b, m, n, at, at) for a, b, m, n in pairs],
        "mmsi_a string, mmsi_b string, message_a bigint, message_b bigint, observed_at_a timestamp, observed_at_b timestamp",
    )
    # A number that two reports share gives a row for each of them, as a join does.
    reports = [(11, 1.0, at), (12, 2.0, at), (13, 3.0, at), (13, 4.0, at), (12, 5.0, datetime(2024, 1, 2))]
    messages = spark.createDataFrame([(i, v, v, v, v, t) for i, v, t in reports], "id bigint, latitude double, longitude double, sog double, cog double, t timestamp")
    vessels = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", None)], "mmsi string, vessel_name string")
    stored, cut = [], search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    shown = lambda df: sorted(df.select("message_a", "message_b", "name_a", "name_b", "sog_a", "sog_b").collect(), key=str)
    got = search.encounter_details(found, messages.withColumn(DATE, F.to_date("t")), vessels)
    assert shown(got) == sorted([(11, 12, "A", "B", 1.0, 2.0), *[(m, 13, n, None, v, w) for m, n, v in ((11, "A", 1.0), (12, "B", 2.0)) for w in (3.0, 4.0)]], key=str)
    # Three reports of vessels that are known, one of them under two positions.
    assert stored[0].count() == 4 and not [c for c in got.columns if c.startswith(DATE)]
    undated = search.encounter_details(found, messages, vessels)
    assert sorted(undated.columns) == sorted(got.columns) and undated.count() == 5 + 3


def test_details_leave_encounters_where_they_are_read(spark, monkeypatch):
    from fairlead.plans import search

    n = 40
    pairs = [(str(i), str(j), i, j) for i in range(n) for j in range(i + 1, n)]
    found = spark.createDataFrame(pairs, "mmsi_a string, mmsi_b string, message_a bigint, message_b bigint")
    messages = spark.createDataFrame([(i, 1.0, 2.0, float(i), 4.0) for i in range(n)], "id bigint, latitude double, longitude double, sog double, cog double")
    vessels = spark.createDataFrame([(str(i), f"V{i}") for i in range(n)], "mmsi string, vessel_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Reports that Spark takes for too large to be sent by itself.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = []
        for most, shuffled in ((n, False), (n - 1, True)):
            monkeypatch.setattr(search, "SENT_REPORTS", most)
            got = search.encounter_details(found, messages, vessels)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == shuffled
            rows.append(sorted(got.select("message_a", "message_b", "name_a", "name_b", "sog_a", "sog_b").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows[0] == rows[1] and len(rows[0]) == len(pairs)


def test_straight_line_tells_what_the_great_circle_tells(spark):
    from fairlead.functions import geo

    rng = np.random.default_rng(5)
    places = [(float(a), float(o)) for a, o in _cloud(7, 80)]
    places += [(a, o + float(d)) for a, o in ((0.0, 10.0), (60.0, 179.9), (89.9, 0.0)) for d in rng.uniform(0, 1e-3, 4)]
    df = vessels(spark, [(str(200000000 + i), a, (o + 180.0) % 360.0 - 180.0, 1.0, 0.0) for i, (a, o) in enumerate(places)])
    sides = [df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s in "ab"]
    far = geo.haversine_nm(*[F.col(f"{s}_{c}") for s in "ab" for c in ("latitude", "longitude")])
    every = sides[0].join(sides[1], F.col("a_mmsi") < F.col("b_mmsi")).select("a_mmsi", "b_mmsi", far.alias("d")).collect()
    some = sorted(r.d for r in every if r.d > 0)
    # Radii that are the distance of a pair, to the last bit, and the next smaller number.
    for d in (some[0], some[2], some[len(some) // 3], some[-1]):
        for radius in (d, float(np.nextafter(d, 0.0))):
            got = encounters.encounter_candidates(df, radius, check=False).select("a_mmsi", "b_mmsi").collect()
            assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(r.a_mmsi, r.b_mmsi) for r in every if r.d <= radius}


def test_counters_measure_only_what_may_be_elevated(spark):
    df = _snapshot(spark, 400)
    whole = encounters.collision_scan(df, 20.0, include_low=True, check=False).select("a_id", "b_id", "risk_level").collect()
    levels = encounters.collision_scan(df, 20.0, include_low=True, check=False, measures=False)
    assert len(set(r.risk_level for r in whole)) > 2 and sorted(levels.select("a_id", "b_id", "risk_level").collect()) == sorted(whole)
    # Pairs that are certainly low come without position and speed relative to each other, from which all measures follow.
    flags = encounters.encounter_candidates(df, 20.0, check=False, wanted=lambda p: encounters.may_be_elevated(p, ApproachThresholds(), "_likely"))
    measured = encounters.closest_approach(flags, "_likely")
    assert measured.filter("not _likely").count() > len(whole) / 2 and measured.filter("not _likely and tcpa_minutes is not null").isEmpty()
    got = encounters.store_counters(df, df, encounters.encounter_records(df)).first()
    assert got.candidate_count == got.assessed_candidate_count == len(whole)
    assert got.elevated_encounter_count == sum(r.risk_level != "low" for r in whole) and got.inserted_count == 0
