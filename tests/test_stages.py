"""Late reports, versions of the baseline and encounters of changed vessels."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_streaming import HEADER, inbox, put, store  # noqa: F401

from fairlead.operators import encounters, motion, rules
from fairlead.streaming import ingest, stages
from fairlead.streaming.store import Store

START = datetime(2024, 1, 1)


def line(mmsi, at, latitude, sog=5.0):
    return f"{mmsi},{at.isoformat()}Z,{latitude:.5f},-74.0,{sog},10,10,S\n"


def alerts_of(store):  # noqa: F811
    rows = store.alerts.read().select("mmsi", "timestamp", "anomaly_type", F.round("metric_value", 6)).collect()
    return sorted(map(tuple, rows))


def test_successors_make_alerts_independent_of_the_order(spark, tmp_path):
    rng = random.Random(2)
    reports = []
    for vessel in range(4):
        at, latitude = START + timedelta(minutes=rng.randrange(60)), 40.0
        for _ in range(40):
            # Gaps and jumps, some over midnight and some over a day without reports.
            at += timedelta(minutes=rng.choice([1, 5, 9, 20, 300, 1500 if rng.random() < 0.1 else 3]))
            latitude += rng.choice([0.001, 0.01, 0.4])
            reports.append((f"11111111{vessel}", at, latitude, rng.choice([1.0, 12.0, 30.0])))
    whole = spark.createDataFrame(
        [(i, m, t, y, -74.0, s, 10.0, 10.0) for i, (m, t, y, s) in enumerate(reports)],
        "id bigint, mmsi string, timestamp timestamp, latitude double, longitude double, sog double, cog double, heading double",
    )
    expected = rules.explode_alerts(rules.annotate(motion.live_features(whole)), keep=("id",))
    expected = sorted(map(tuple, expected.select("mmsi", "timestamp", "anomaly_type", F.round("metric_value", 6)).collect()))
    rng.shuffle(reports)
    store_, folder = Store(spark, str(tmp_path / "late")), tmp_path / "deliveries"
    folder.mkdir()
    for number in range(3):
        put(folder, f"{number}.csv", HEADER + "".join(line(*r) for r in reports[number::3]))
        jobs = ingest.ingest_directory(store_, str(folder), stages.RECOMPUTING_STAGES[:1])
        assert [j.analytics_status for j in jobs] == ["completed"], jobs
        if number == 1:
            before = alerts_of(store_)
    # Alerts that were right after two deliveries are gone after the third.
    assert alerts_of(store_) == expected and set(before) - set(expected)


def test_alerts_of_a_day_can_all_go(store, inbox):  # noqa: F811
    put(inbox, "a.csv", HEADER + line("111111111", START, 40.0) + line("111111111", START + timedelta(days=1), 40.0))
    ingest.ingest_directory(store, str(inbox), stages.RECOMPUTING_STAGES[:1])
    assert [r[2] for r in alerts_of(store)] == ["reporting_gap"]
    near = START + timedelta(hours=23, minutes=50)
    put(inbox, "b.csv", HEADER + line("111111111", near, 40.0) + "".join(line("111111111", START + timedelta(minutes=14 * i), 40.0) for i in range(1, 103)))
    ingest.ingest_directory(store, str(inbox), stages.RECOMPUTING_STAGES[:1])
    assert alerts_of(store) == []


def test_baseline_versions(spark, store, inbox, monkeypatch):  # noqa: F811
    monkeypatch.setattr(stages.iforest, "TREES", 10)
    original = stages.Baseline.fit.__func__
    fitted = []

    def small(cls, day, version, trees=10):
        fitted.append((version, day.count()))
        return original(cls, day, version, 10)

    monkeypatch.setattr(stages.Baseline, "fit", classmethod(small))
    with pytest.raises(RuntimeError, match="no stored reports"):
        stages.stored_baseline(store)
    counts = {0: 30, 1: 50, 2: 20}
    for day, count in counts.items():
        at = START + timedelta(days=day)
        put(inbox, f"{day}.csv", HEADER + "".join(line("111111111", at + timedelta(minutes=i), 40 + i / 500, i % 7) for i in range(count)))
        job = ingest.ingest_directory(store, str(inbox), (stages.risk_stage,))[0]
        assert job.analytics_status == "completed", job.analytics_error
    # The growing day is never learnt from once there is an earlier one; a denser complete day makes a new version.
    assert fitted == [("2024-01-01.open", 30), ("2024-01-01", 30), ("2024-01-02", 50)]
    named = store.risks.read().groupBy(F.to_date("timestamp").alias("d"), "assessment_version").count().orderBy("d").collect()
    versions = ["2024-01-01.open", "2024-01-01", "2024-01-02"]
    assert [(r["assessment_version"], r["count"]) for r in named] == [(f"hybrid-v1@{v}", n) for v, n in zip(versions, counts.values())]
    # Every version can be had again, as of a day.
    assert stages.stored_baseline(store, as_of=date(2024, 1, 2)).version == "2024-01-01" and len(fitted) == 3
    assert stages.stored_baseline(store, as_of=date(2024, 1, 1)).version == "2024-01-01.open" and len(fitted) == 3


def snapshot(spark, rng, n):
    rows = [
        (f"{100000000 + i}", i, START + timedelta(seconds=rng.randrange(300)), rng.uniform(40, 42), rng.uniform(-75, -72), rng.uniform(0, 20), rng.uniform(0, 360))
        for i in range(n)
    ]
    rows += [(f"{200000000 + i}", 1000 + i, START, 89.9, rng.uniform(-180, 180), 9.0, 0.0) for i in range(5)]
    rows += [(f"{300000000 + i}", 2000 + i, START, 10.0, x, 9.0, 0.0) for i, x in enumerate((-179.99, 179.99, 179.9))]
    return spark.createDataFrame(rows, "mmsi string, id bigint, timestamp timestamp, latitude double, longitude double, sog double, cog double")


@pytest.mark.parametrize("cell_rows", [20_000, 5])
def test_pairs_of_changed_vessels(spark, cell_rows):
    vessels = snapshot(spark, random.Random(7), 250)
    flagged = vessels.withColumn("_changed", F.pmod(F.xxhash64("mmsi"), F.lit(10)) < 2)
    changed = {r.mmsi for r in flagged.filter("_changed").collect()}
    names = ["a_mmsi", "b_mmsi", "a_id", "b_id", "a_latitude", "b_latitude"]
    full = encounters.encounter_candidates(vessels, 20.0, 5.0, cell_rows=cell_rows).select(*names)
    delta = encounters.encounter_candidates(flagged, 20.0, 5.0, cell_rows=cell_rows, changed="_changed").select(*names)
    expected = sorted(tuple(r) for r in full.collect() if {r.a_mmsi, r.b_mmsi} & changed)
    got = sorted(map(tuple, delta.collect()))
    assert got == expected and 0 < len(got) < full.count()


def test_pairs_cost_what_changed(spark):
    """Only changed vessels are dealt to the cells around them."""
    vessels = snapshot(spark, random.Random(7), 250).withColumn("_changed", F.col("mmsi") == "100000007")
    plan = encounters.encounter_candidates(vessels, changed="_changed", check=False)._jdf.queryExecution().optimizedPlan().toString()
    searching = [part for part in plan.split("Generate explode") if "_changed" in part]
    assert searching and "100000007" in plan
    one = encounters.encounter_candidates(vessels, 300.0, changed="_changed").select("a_mmsi", "b_mmsi").collect()
    assert one and all("100000007" in tuple(r) for r in one)


def test_changed_vessels_find_what_a_full_scan_finds(spark, store, inbox):  # noqa: F811
    rng, expected = random.Random(3), set()
    names = ("mmsi_a", "mmsi_b", "message_a", "message_b", "risk_level")
    for number in range(2):
        at = START + timedelta(minutes=4 * number)
        body = "".join(
            f"{111111100 + v},{at.isoformat()}Z,{40 + rng.uniform(0, 0.3):.4f},{-74 + rng.uniform(0, 0.3):.4f},{rng.uniform(5, 20):.1f},{rng.randrange(360)},10,S\n"
            for v in range(20) if number == 0 or v % 3 == 0
        )
        put(inbox, f"{number}.csv", HEADER + body)
        ingest.ingest_directory(store, str(inbox), (stages.collision_stage,))
        full = encounters.encounter_records(encounters.snapshot_of(store.latest.read()))
        expected |= set(map(tuple, full.select(*names).collect()))
    stored = sorted(map(tuple, store.encounters.read().select(*names).collect()))
    assert stored == sorted(expected) and len(stored) > 10
    # A full scan adds nothing to it.
    assert stages.full_collision_stage(store, None).created == 0


def test_copies_go_with_the_stage_that_made_them(spark, tmp_path):
    import os

    from fairlead.session import cut_lineage, temporary_stages
    from fairlead.streaming.stages import BatchContext, StageResult, run_stages
    from fairlead.streaming.store import Store

    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    own, shared = [], []

    def first(store, batch):
        own.append(cut_lineage(spark.range(3)))
        shared.append(cut_lineage(spark.range(4), outer=True))
        assert there(own[0]) and there(shared[0])
        return StageResult("first", own[0].count())

    def second(store, batch):
        assert not there(own[0]) and there(shared[0])
        return StageResult("second", shared[0].count())

    with temporary_stages(spark):
        # Empty scopes are equal: the inner one must go, not the first that is like it.
        with temporary_stages(spark):
            pass
        results = run_stages(Store(spark, str(tmp_path)), BatchContext(spark.range(1)), (first, second))
        assert [r.processed for r in results] == [3, 4] and there(shared[0])
    assert not there(shared[0])


def test_copies_of_an_import_are_gone_before_its_analytics(spark, tmp_path, monkeypatch):
    import os

    from fairlead import session
    from fairlead.streaming import ingest
    from fairlead.streaming.stages import StageResult
    from fairlead.streaming.store import Store

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("mmsi,timestamp,latitude,longitude,sog,cog,heading\n111111111,2024-01-01T00:00:00Z,1.0,2.0,3,4,5\n")
    made, scratch = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *a: made.append(scratch(*a)) or made[-1])
    left = []

    def stage(store, batch):
        left.append([p for p in made if os.path.exists(p)])
        return StageResult("count", batch.keys.count())

    done = ingest.ingest_directory(Store(spark, str(tmp_path / "store")), str(tmp_path / "in"), (stage,))
    assert [(j.error_message, j.status, j.analytics_status, j.rows_imported) for j in done] == [(None, "completed", "completed", 1)]
    # The digests of the files and the keys.
    assert len(made) > 5 and len(left[0]) == 2 and not any(os.path.exists(p) for p in made)
