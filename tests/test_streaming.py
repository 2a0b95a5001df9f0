from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fairlead.session import shared_dir
from fairlead.streaming import ingest, stages
from fairlead.streaming.stages import StageResult
from fairlead.streaming.store import Store

HEADER = "mmsi,timestamp,latitude,longitude,sog,cog,heading,vessel_name\n"


def lines(mmsi, start, count, step=60, latitude=40.0, speed=5.0):
    base = datetime(2024, 1, 1).timestamp() + start
    return "".join(
        f"{mmsi},{datetime.fromtimestamp(base + i * step).isoformat()}Z,{latitude + i * 0.001:.4f},-74.0,{speed},{(i * 7) % 360},{i % 360},SHIP {mmsi}\n"
        for i in range(count)
    )


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    return folder


def put(inbox, name, text):
    (inbox / name).write_text(text)


def test_import_counts_and_skips(store, inbox):
    body = HEADER + lines("111111111", 0, 10) + "bad,2024-01-01T00:00:00Z,1,2,3,4,5,x\n" + lines("111111111", 0, 1)
    put(inbox, "a.csv", body)
    put(inbox, "b.csv", body)  # equal content: one job
    put(inbox, "c.csv", HEADER + lines("111111111", 300, 10))
    first = {j.source_file[-5:]: j for j in ingest.ingest_directory(store, str(inbox), stages=None)}
    assert set(first) == {"a.csv", "c.csv"}
    a, c = first["a.csv"], first["c.csv"]
    assert (a.rows_read, a.rows_imported, a.rows_rejected, a.duplicates_skipped) == (12, 10, 1, 1)
    assert (c.rows_read, c.rows_rejected) == (10, 0) and a.analytics_status == "not_requested"
    assert ingest.ingest_directory(store, str(inbox), stages=None) == []
    put(inbox, "a.csv", body + lines("222222222", 0, 2))  # changed content is new
    changed = ingest.ingest_directory(store, str(inbox), stages=None)
    assert [(j.rows_imported, j.duplicates_skipped) for j in changed] == [(2, 11)]
    messages = store.messages.read()
    assert messages.count() == messages.select("id").distinct().count() == a.rows_imported + c.rows_imported + 2
    vessel = store.vessels.read().filter("mmsi = '111111111'").first()
    assert vessel.vessel_name == "SHIP 111111111" and vessel.first_seen.minute == 0


def test_unreadable_file_fails_alone_and_can_be_retried(store, inbox):
    put(inbox, "bad.csv", "mmsi,sog\n1,2\n")
    put(inbox, "good.csv", HEADER + lines("111111111", 0, 3))
    by_name = {j.source_file.split("/")[-1]: j for j in ingest.ingest_directory(store, str(inbox), stages=None)}
    assert by_name["bad.csv"].status == "failed" and "latitude, longitude, timestamp" in by_name["bad.csv"].error_message
    assert by_name["good.csv"].status == "completed"
    again = ingest.retry_failed(store, stages=None)
    assert [j.status for j in again] == ["failed"]
    assert store.registry.jobs().count() == 2


def count_keys(seen):
    def stage(store, batch):
        seen.append(batch.keys.count())
        return StageResult("count", seen[-1], 0)

    return stage


def test_analytics_follow_after_a_crash(store, inbox, monkeypatch):
    """Killed after the messages were appended, before anything was recorded."""
    put(inbox, "a.csv", HEADER + lines("111111111", 0, 4) + lines("111111111", 9000, 1))
    seen = []

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ingest, "_counted", killed)
    with pytest.raises(KeyboardInterrupt):
        ingest.ingest_directory(store, str(inbox), stages=(count_keys(seen),))
    monkeypatch.undo()
    assert store.messages.read().count() == 5 and seen == []
    assert [r.status for r in store.registry.jobs().collect()] == ["running"]
    job = ingest.ingest_directory(store, str(inbox), stages=(count_keys(seen), stages.rule_stage))[0]
    assert (job.status, job.analytics_status, job.rows_imported, job.duplicates_skipped) == ("completed", "completed", 5, 0)
    assert seen == [5] and store.messages.read().count() == 5
    assert store.alerts.read().filter("anomaly_type = 'reporting_gap'").count() == 1


def test_rows_outside_the_limits_go_to_quarantine(store, inbox):
    at = "2024-01-01T00:00:0{}Z,40.0,-74.0,{}"
    rows = ["5,10,511", "102.3,360,10", "-1,10,10", "5,10,10", ",,"]
    body = HEADER + "".join(f"111111111,{at.format(i, r)},S\n" for i, r in enumerate(rows))
    put(inbox, "a.csv", body)
    for _ in range(2):
        jobs = ingest.ingest_directory(store, str(inbox), stages=None)
        if jobs:
            first = jobs[0]
    assert (first.rows_read, first.rows_imported, first.rows_quarantined, first.rows_rejected, first.duplicates_skipped) == (5, 2, 3, 0, 0)
    assert store.messages.read().count() == 2 and store.quarantine.read().count() == 3
    assert {r.heading for r in store.quarantine.read().collect()} == {511.0, 10.0}
    assert store.messages.read().filter("position = 'POINT(-74.0 40.0)'").count() == 2


def test_ids_never_run_out(store, inbox):
    """Far more rows than any earlier numbering allowed."""
    from fairlead.streaming.registry import Job

    before = 5_000_000_000_000_000
    store.registry.record([Job("f" * 64, "/old.csv", 1, status="completed", next_id=before)])
    put(inbox, "a.csv", HEADER + lines("111111111", 0, 3))
    put(inbox, "b.csv", HEADER.replace("heading,", "").replace("mmsi,timestamp", "mmsi,timestamp") + "222222222,2024-01-01T00:00:00Z,40.0,-74.0,5,10,B\n")
    assert len(ingest.ingest_directory(store, str(inbox), stages=None)) == 2
    assert sorted(r.id - before for r in store.messages.read().collect()) == [0, 1, 2, 3]
    put(inbox, "c.csv", HEADER + lines("333333333", 0, 2))
    ingest.ingest_directory(store, str(inbox), stages=None)
    assert store.messages.read().agg(F.max("id")).first()[0] == before + 5


def test_folder_in_several_batches_and_compaction(spark, store, inbox, monkeypatch):
    from fairlead.sources.files import file_digests
    from fairlead.streaming import registry

    monkeypatch.setattr(registry, "COMPACT_AFTER", 2)
    for i in range(5):
        put(inbox, f"{i}.csv", HEADER + lines(f"11111111{i}", 0, 2))
    put(inbox, "bad.csv", "mmsi,sog\n1,2\n")
    jobs = ingest.ingest_batch(store, file_digests(spark, str(inbox)), None, most=2)
    assert sorted(j.status for j in jobs) == ["completed"] * 5 + ["failed"]
    assert store.registry.jobs().count() == 6 and len(store.registry._batches()) <= 3
    assert store.registry.jobs().filter("status = 'completed'").agg(F.sum("rows_imported")).first()[0] == 10
    assert store.messages.read().select("id").distinct().count() == 10
    assert store.registry.jobs().select(F.max(F.length("job_id"))).first()[0] == 64


def test_digest_is_streamed_in_pieces(spark, inbox):
    import hashlib

    from fairlead.sources import files

    data = b"mmsi,x\r\n" + b"0123456789\n" * 300_000  # more than three pieces
    (inbox / "big.csv").write_bytes(data)
    got = {r.name: r for r in files.file_digests(spark, str(inbox)).collect()}
    assert got["big.csv"].content_sha256 == hashlib.sha256(data).hexdigest() and got["big.csv"].header == "mmsi,x"
    assert got["big.csv"].size_bytes == len(data)
    plan = files.file_digests(spark, str(inbox))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan


def test_stage_order_failure_and_retry(store, inbox):
    put(inbox, "a.csv", HEADER + lines("111111111", 0, 3))
    seen = []

    def good(store, batch):
        seen.append(batch.keys.count())
        return StageResult("good", 3, 1)

    def broken(store, batch):
        raise RuntimeError("x" * 5000)

    def never(store, batch):
        raise AssertionError("must not run")

    job = ingest.ingest_directory(store, str(inbox), stages=(good, broken, never))[0]
    assert job.status == "completed" and job.analytics_status == "failed"
    assert job.analytics_error.endswith("x" * 5000)  # the whole text
    assert seen == [3] and store.messages.read().count() == 3
    assert ingest.ingest_directory(store, str(inbox), stages=(good,)) == []
    assert ingest.retry_analytics(store, (good,)) and seen == [3, 3]
    assert not ingest.retry_analytics(store, (good,))
    put(inbox, "empty.csv", HEADER)
    assert [j.analytics_status for j in ingest.ingest_directory(store, str(inbox), stages=(never,))] == ["skipped"]


def test_stream_with_all_stages(spark, store, inbox, tmp_path, monkeypatch):
    monkeypatch.setattr(stages.iforest, "TREES", 20)
    fitted = []
    original = stages.Baseline.fit.__func__

    def counted(cls, day, version, trees=20):
        fitted.append(version)
        return original(cls, day, version, 20)

    monkeypatch.setattr(stages.Baseline, "fit", classmethod(counted))
    checkpoint = str(tmp_path / "checkpoint")
    stages_before = len(list(Path(shared_dir(spark)).glob("stage-*")))

    def run():
        query = ingest.start_ingestion(store, str(inbox), checkpoint)
        query.awaitTermination(240)
        assert query.exception() is None

    put(inbox, "one.csv", HEADER + lines("111111111", 0, 30) + lines("222222222", 0, 30, latitude=40.0005))
    run()
    assert store.registry.jobs().first().analytics_status == "completed", store.registry.jobs().first().analytics_error
    assert store.risks.read().count() == 60 and store.encounters.read().count() == 1
    before = {r.message_id: r.ml_anomaly_score for r in store.risks.read().collect()}
    # A report after 40 minutes raises a gap alert for the new row only.
    put(inbox, "two.csv", HEADER + lines("111111111", 29 * 60 + 2400, 1, latitude=40.03))
    run()
    alerts = store.alerts.read().filter("anomaly_type = 'reporting_gap'").collect()
    assert len(alerts) == 1 and alerts[0].metric_value == pytest.approx(40.0)
    after = {r.message_id: r.ml_anomaly_score for r in store.risks.read().collect()}
    assert len(after) == 61 and all(after[k] == pytest.approx(v) for k, v in before.items())
    assert fitted == ["2024-01-01.open"]
    run()
    assert store.messages.read().count() == 61
    assert len(list(Path(shared_dir(spark)).glob("stage-*"))) == stages_before


def test_values_of_a_file_are_parsed_once(store, inbox, monkeypatch):
    put(inbox, "a.csv", HEADER + lines("111111111", 0, 10))
    seen, split = [], ingest.check_constraints
    monkeypatch.setattr(ingest, "check_constraints", lambda df: seen.append(df) or split(df))
    done = ingest.ingest_directory(store, str(inbox), stages=None)
    assert [j.rows_imported for j in done] == [10]
    plan = seen[0]._jdf.queryExecution().logical().toString()
    assert "parquet" in plan and "Project" not in plan


def test_rows_of_a_file_are_tested_once_for_both_results(spark):
    from fairlead.operators import linking
    from fairlead.session import cut_lineage

    columns = "mmsi string, timestamp string, latitude string, longitude string"
    rows = spark.createDataFrame([("111111111", "2024-01-01T00:00:00Z", "40", "-74"), ("bad", None, "x", "1")], columns)
    copies = []
    valid, rejected = linking.import_validate(rows, lambda df: copies.append(cut_lineage(df)) or copies[-1])
    assert (valid.count(), rejected.count(), len(copies)) == (1, 1, 1)
    for part in (valid, rejected):
        assert "RLIKE" not in part._jdf.queryExecution().executedPlan().toString()


def test_days_without_stored_rows_are_not_joined(spark, store, monkeypatch):
    from fairlead.sources import tables

    day = "job string, mmsi string, timestamp timestamp, latitude double, longitude double"
    held = tables.DatedTable(spark, f"{store.root}/some", day, ("mmsi", "timestamp"))
    rows = lambda *days: spark.createDataFrame([("j", "111111111", datetime(2024, 1, d), 1.0, 2.0) for d in days], day)
    joined, stored_on = [], tables.DatedTable._stored_on
    monkeypatch.setattr(tables.DatedTable, "_stored_on", lambda self, batch: joined.append(1) or stored_on(self, batch))
    assert held.upsert(rows(1, 2).withColumn("o", F.lit(1)), "timestamp") == 2 and not joined
    # A day that is stored is joined, also beside a new one.
    assert held.upsert(rows(2, 3), "timestamp") == 2 and len(joined) == 1
    fresh = held.new_rows(rows(3, 4).withColumn("n", F.lit(1)), "n")
    assert [r.timestamp.day for r in fresh.collect()] == [4] and len(joined) == 2
    assert held.new_rows(rows(8).withColumn("n", F.lit(1)), "n").count() == 1 and len(joined) == 2
    assert sorted(r.timestamp.day for r in held.read().collect()) == [1, 2, 3]
