"""Streaming features against the batch operator, for reports in any order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fairlead.operators import motion
from fairlead.streaming.stateful import end_marker, report_stream, stateful_motion

SCHEMA = "id bigint, mmsi string, timestamp timestamp, latitude double, longitude double, sog double, cog double, heading double"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run(spark, tmp_path, *parts, **options):
    """One run of the stream per part; the rows of each run."""
    given = spark.createDataFrame([], SCHEMA).schema
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        features = stateful_motion(report_stream(spark, str(tmp_path / "in"), given), **options)
        query = (
            features.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(180)
        assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def reports(seed=4):
    rng, rows = random.Random(seed), []
    for i in range(900):
        # Vessel 1 has most of the reports; times tie, and some measures are missing.
        mmsi = "1" if rng.random() < 0.6 else str(rng.randrange(2, 9))
        at = START + timedelta(seconds=rng.randrange(6 * 3600) // 5 * 5)
        measures = [rng.uniform(30, 31), rng.uniform(5, 6), *(rng.choice([None, rng.uniform(0, 50)]) for _ in range(3))]
        rows.append((i, mmsi, at, *measures))
    rng.shuffle(rows)
    return rows


def comparable(df):
    names = sorted(df.columns)
    out = []
    for r in df.select(*names).collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


def test_any_order_gives_the_batch_result(spark, tmp_path):
    rows = reports()
    parts = [spark.createDataFrame(rows[i::3], SCHEMA) for i in range(3)]
    end = end_marker(spark, parts[0].schema, START + timedelta(days=1))
    got = run(spark, tmp_path, *parts, end, lateness="7 hours", slice_seconds=600)
    assert got.count() == len(rows)
    expected = motion.live_features(spark.createDataFrame(rows, SCHEMA)).select(*got.columns)
    assert comparable(got) == comparable(expected)


def test_waiting_rows_late_rows_and_rows_of_no_vessel(spark, tmp_path):
    at = lambda minute: START + timedelta(minutes=minute)
    row = lambda i, mmsi, minute: (i, mmsi, at(minute), 0.0, minute / 100, 10.0, 1.0, 1.0)
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    options = {"lateness": "10 minutes", "slice_seconds": 60}
    got = run(spark, tmp_path, frame(row(1, "1", 0), row(3, "1", 4), row(9, None, 1), (8, "1", None, 0.0, 0.0, None, None, None)), **options)
    # Nothing is released before its slice is ten minutes old.
    assert [r.id for r in got.collect()] == [9]
    got = run(spark, tmp_path, frame(row(2, "1", 2), row(4, "1", 20)), **options)
    by_id = {r.id: r for r in got.collect()}
    assert sorted(by_id) == [1, 2, 3, 9] and by_id[9].elapsed_seconds is None and by_id[1].elapsed_seconds is None
    assert by_id[2].elapsed_seconds == by_id[3].elapsed_seconds == 120.0
    # Minute 5 is past the bound, minute 15 is not.
    end = end_marker(spark, frame(row(1, "1", 0)).schema, at(60))
    got = run(spark, tmp_path, frame(row(5, "1", 5), row(6, "1", 15)), end, **options)
    by_id = {r.id: r for r in got.collect()}
    assert sorted(by_id) == [1, 2, 3, 4, 6, 9]
    assert by_id[6].elapsed_seconds == 660.0 and by_id[4].elapsed_seconds == 300.0
    assert got.filter(F.col("id") == 4).first().distance_nm == pytest.approx(3.0, rel=0.01)


def test_vessels_share_state_and_keep_their_own_tracks(spark, tmp_path):
    """Two buckets for eight vessels: several slices and runs, each vessel linked to its own reports only."""
    rows = reports(seed=9)
    parts = [spark.createDataFrame(rows[i::2], SCHEMA) for i in range(2)]
    end = end_marker(spark, parts[0].schema, START + timedelta(days=1))
    got = run(spark, tmp_path, *parts, end, lateness="7 hours", slice_seconds=1800, buckets=2)
    expected = motion.live_features(spark.createDataFrame(rows, SCHEMA)).select(*got.columns)
    assert got.count() == len(rows) and comparable(got) == comparable(expected)
