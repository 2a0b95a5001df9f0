import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fairlead.functions.dates import DATE
from fairlead.operators import cleaning, linking
from fairlead.plans import playback, search
from fairlead.sources import files, geojson, replay
from fairlead.sources.tables import DatedTable, VersionedTable

HEADER = "MMSI,BaseDateTime,LAT,LON,SOG\n"


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_raw_scan_keeps_text_and_order(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + "".join(f"{100000000 + i},2024-01-01T00:00:{i:02d},1.0,2.0,3\n" for i in range(30)))
    raw = files.scan_raw_csv(spark, path)
    assert dict(raw.dtypes)["MMSI"] == "string"
    assert [r.MMSI for r in raw.orderBy("ord").collect()] == [str(100000000 + i) for i in range(30)]
    assert files.scan_raw_csv(spark, path, 5).count() == 5
    assert cleaning.clean(raw).report.first().rows_clean == 30
    with pytest.raises(ValueError):
        files.scan_raw_csv(spark, path, 0)


def test_typed_scan(spark, tmp_path):
    path = write(tmp_path / "t.csv", "mmsi,sog\n012345678,5.5\n123456789,bad\n")
    got = files.scan_typed_csv(spark, path, "mmsi string, sog double").orderBy("ord").collect()
    assert [(r.mmsi, r.sog) for r in got] == [("012345678", 5.5), ("123456789", None)]


def test_replay_scan_with_bom(spark, tmp_path):
    path = write(tmp_path / "r.csv", "timestamp,mmsi\n2024-01-01T00:02:00Z,2\nnever,3\n2024-01-01 00:01:00,1\n", "utf-8-sig")
    rows, skipped = files.scan_replay_csv(spark, path)
    assert [r.mmsi for r in rows.collect()] == ["1", "2"]
    assert tuple(skipped.first()) == (2, 1)
    with pytest.raises(ValueError, match="when"):
        files.scan_replay_csv(spark, path, "when")


def test_pruned_scan_reads_two_columns(spark, tmp_path):
    path = write(tmp_path / "p.csv", "mmsi,timestamp,latitude,longitude\n999111222,2024-01-01,1,2\n999111222.0,2024-01-02,1,2\nbad,2024-01-01,1,2\n")
    keys = linking.incoming_keys(files.scan_columns(spark, path, ["mmsi", "timestamp"]))
    assert {r.mmsi for r in keys.collect()} == {"999111222"} and keys.count() == 2
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<mmsi:string,timestamp:string>" in plan


def test_digests(spark, tmp_path):
    write(tmp_path / "b.csv", "x"), write(tmp_path / "a.csv", "y"), write(tmp_path / ".hidden.csv", "z"), write(tmp_path / "c.txt", "t")
    got = files.file_digests(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.size_bytes, r.content_sha256) for r in got] == [
        ("a.csv", 1, hashlib.sha256(b"y").hexdigest()), ("b.csv", 1, hashlib.sha256(b"x").hexdigest()),
    ]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", datetime(2024, 1, 1))], "mmsi string, timestamp timestamp")
    files.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["mmsi", "timestamp"] and back.first().timestamp.startswith("2024-01-01T00:00:00")
    report = cleaning.quality_report(cleaning.standardize(spark.createDataFrame([("1", "2024-01-01", "1", "1")], ["mmsi", "timestamp", "latitude", "longitude"])))
    files.write_json_report(report, str(tmp_path / "json"))
    text = next(line for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines())
    assert json.loads(text)["rows_read"] == 1 and "earliest_timestamp" in json.loads(text)


SCHEMA = "id bigint, timestamp timestamp, v string"


def rows(spark, *values):
    return spark.createDataFrame([(i, datetime.fromisoformat(t), v) for i, t, v in values], SCHEMA)


def test_insert_new_ignores_stored_and_repeated(spark, tmp_path):
    table = DatedTable(spark, str(tmp_path / "t"), SCHEMA, ("id",))
    assert table.read().count() == 0
    assert table.insert_new(rows(spark, (1, "2024-01-01", "a"), (1, "2024-01-01", "b"), (2, "2024-01-02", "c")), "id") == (3, 2)
    batch = rows(spark, (1, "2024-01-01", "z"), (3, "2024-01-02", "d"))
    assert table.insert_new(batch, "id") == (2, 1)
    assert table.insert_new(batch, "id") == (2, 0)
    assert {(r.id, r.v) for r in table.read().filter("id > 1").collect()} == {(2, "c"), (3, "d")}


def test_upsert_replaces_and_keeps_other_dates(spark, tmp_path):
    table = DatedTable(spark, str(tmp_path / "t"), SCHEMA, ("id",))
    assert table.upsert(rows(spark, (1, "2024-01-01", "a"), (2, "2024-01-01", "b"), (3, "2024-01-03", "c")), "v") == 3
    again = rows(spark, (1, "2024-01-01", "A"), (4, "2024-01-02", "d"), (4, "2024-01-02", "e"))
    for _ in range(2):
        assert table.upsert(again, "v") == 2
        assert {(r.id, r.v) for r in table.read().collect()} == {(1, "A"), (2, "b"), (3, "c"), (4, "e")}
    assert table.upsert(rows(spark), "v") == 0


def test_vessel_merge(spark, tmp_path):
    from fairlead.streaming.store import VESSELS

    table = VersionedTable(spark, str(tmp_path / "v"), VESSELS)
    reports = lambda *r: spark.createDataFrame(
        [(o, m, datetime.fromisoformat(t), n, c) for o, m, t, n, c in r], "ord long, mmsi string, timestamp timestamp, vessel_name string, call_sign string"
    )
    table.merge_vessels(linking.vessel_dim(reports((1, "1", "2024-01-02", "old", "CS"), (2, "1", "2024-01-03", None, None))))
    table.merge_vessels(linking.vessel_dim(reports((1, "1", "2024-01-01", "new", None), (2, "2", "2024-01-05", " ", "X"))))
    got = {r.mmsi: r for r in table.read().collect()}
    assert got["1"].vessel_name == "new" and got["1"].call_sign == "CS"
    assert (got["1"].first_seen, got["1"].last_seen) == (datetime(2024, 1, 1), datetime(2024, 1, 3))
    assert got["2"].vessel_name is None
    for _ in range(6):
        table.replace(table.read())
    # Young versions stay however many there are; old ones go once their successor is old too.
    assert len(list((tmp_path / "v").glob("v=*"))) == 8
    short = VersionedTable(spark, str(tmp_path / "v"), VESSELS, keep_seconds=0.0)
    short.replace(short.read())
    assert [p.name for p in (tmp_path / "v").glob("v=*")] == ["v=9"] and short.read().count() == 2
    # An unfinished version is not seen.
    (tmp_path / "v" / "v=99").mkdir()
    assert table.read().count() == 2


def test_alert_and_risk_links(spark):
    messages = spark.createDataFrame([(5, "1", 10, 1.0, 2.0), (9, "1", 10, 3.0, 4.0)], "id long, mmsi string, timestamp long, latitude double, longitude double")
    alerts = spark.createDataFrame([("1", 10, 1.0, 2.0), ("1", 10, 1.0, 2.5)], "mmsi string, timestamp long, latitude double, longitude double")
    linked = linking.link_alerts(alerts, messages)
    assert [r.message_id for r in linking.matched(linked).collect()] == [5]
    assert tuple(linking.unmatched_count(linked).first()) == (1, 1)
    risks = spark.createDataFrame([("1", 10), ("2", 10)], "mmsi string, timestamp long")
    assert {r.mmsi: r.message_id for r in linking.link_risk(risks, messages).collect()} == {"1": 9, "2": None}


def test_message_projection(spark):
    df = spark.createDataFrame([(1, "237727000", datetime(2024, 1, 1), 37.9838, 23.7275, "5.5", "7.9", " ", "TRUE")],
                               "id long, mmsi string, timestamp timestamp, latitude double, longitude double, sog string, navigation_status string, transceiver_class string, sog_unavailable string")
    got = linking.message_project(df).first()
    assert got.position == "POINT(23.7275 37.9838)" and got.sog == 5.5 and got.navigation_status == 7
    assert got.transceiver_class is None and got.sog_unavailable and got.cog is None and not got.cog_unavailable


def recording(spark):
    data = [("227730770", "2024-01-01 00:00:00"), ("368000170", "2024-01-01 00:02:00"), ("227730770", "2024-01-01 00:10:20")]
    return spark.createDataFrame(data, "mmsi string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))


def test_replay_buckets_and_names(spark, tmp_path):
    got = replay.replay(recording(spark), datetime(2025, 6, 1)).orderBy("timestamp").collect()
    assert [(r.bucket, r.sequence, r.offset_seconds) for r in got] == [(0, 1, 0.0), (0, 1, 0.0), (2, 2, 600.0)]
    assert [r.mmsi for r in got] == ["990000001", "990000002", "990000001"]
    assert (got[2].timestamp - got[0].timestamp).total_seconds() == 620
    replay.write_time_batches(replay.replay(recording(spark), datetime(2025, 6, 1)), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 3 and {r.sequence for r in back.select("sequence").distinct().collect()} == {1, 2}
    assert back.orderBy("timestamp").first().timestamp == "2025-06-01 00:00:00Z"


def test_replay_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        replay.time_bucket(recording(spark), 0)
    with pytest.raises(ValueError, match="nine digits"):
        replay.mmsi_mapping(recording(spark), 1_000_000_000)
    with pytest.raises(Exception, match="nine digits"):
        replay.mmsi_mapping(recording(spark), 999_999_999).collect()
    with pytest.raises(ValueError, match="no row with a valid time"):
        path = tmp_path / "times.csv"
        path.write_text("mmsi,timestamp\n1,never\n")
        files.scan_replay_csv(spark, str(path))
    with pytest.raises(ValueError, match="no MMSI"):
        replay.mmsi_mapping(recording(spark).withColumn("mmsi", F.lit(" ")))


def test_trajectory_geometry_and_bounds(spark):
    points = spark.createDataFrame([(1, "1", datetime(2024, 1, 1, 0), 1.0, 2.0), (2, "1", datetime(2024, 1, 1, 1), 1.5, 2.5), (3, "2", datetime(2024, 1, 1, 0), 3.0, 4.0)],
                                   "id long, mmsi string, timestamp timestamp, latitude double, longitude double")
    tracks = {r.mmsi: r for r in search.vessel_trajectories(search.trajectory_points(points)).collect()}
    assert tracks["1"].geometry.type == "LineString" and tracks["1"].geometry.coordinates == [[2.0, 1.0], [2.5, 1.5]]
    assert tracks["2"].geometry.type == "Point" and tracks["2"].point_count == 1
    assert geojson.trajectory_features(search.vessel_trajectories(search.trajectory_points(points))).count() == 1
    one = search.vessel_trajectories(search.trajectory_points(points, limit=1)).filter("mmsi = '1'").first()
    assert one.point_count == 1 and one.end_time == datetime(2024, 1, 1)
    clipped = search.clip_trajectory(search.vessel_trajectories(search.trajectory_points(points)), datetime(2023, 1, 1)).first()
    assert clipped.point_count == 0 and clipped.start_time is None and clipped.geometry.coordinates == []
    with pytest.raises(ValueError):
        search.trajectory_points(points, datetime(2024, 2, 1), datetime(2024, 1, 1))
    with pytest.raises(LookupError):
        search.known_vessel(points, "9")


def test_playback_of_nothing_and_ties(spark):
    empty = spark.createDataFrame([], "id long, mmsi string, timestamp timestamp")
    assert tuple(playback.playback_bounds(empty).first()) == (None, None, 0, 0)
    tie = spark.createDataFrame([(1, "1", datetime(2024, 1, 2)), (2, "1", datetime(2024, 1, 1))], "id long, mmsi string, timestamp timestamp")
    assert playback.playback_bounds(tie).first().start_time == datetime(2024, 1, 1)


def test_thinning(spark):
    rows = [(i, str(i % 2), datetime(2024, 1, 1, 0, i // 60, i % 60), i % 10 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, mmsi string, timestamp timestamp, has_anomaly boolean")
    kept = geojson.marker_thinning(df, 30)
    assert kept.filter("has_anomaly").count() == 20
    assert {r["mmsi"]: r["count"] for r in kept.filter("not has_anomaly").groupBy("mmsi").count().collect()} == {"0": 30, "1": 30}
    assert geojson.marker_thinning(df, 0).count() == 200


def test_numbers_by_ranges(spark):
    """Numbers of every group are 0, 1, ... in order, over several ranges, with ties and nulls."""
    from fairlead.operators.numbering import numbered

    rows = [("hot" if i % 3 else None, (i * 7919) % 500, i) for i in range(2000)] + [("one", 1, 5)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(6)
    out = numbered(df, [F.col("v").desc(), "i"], ["g"], "number", "total")
    assert out.columns == ["g", "v", "i", "number", "total"]
    by_group = {}
    for r in out.collect():
        by_group.setdefault(r.g, []).append(r)
    for g, group in by_group.items():
        group.sort(key=lambda r: r.number)
        assert [r.number for r in group] == list(range(len(group))) and {r.total for r in group} == {len(group)}
        assert [(r.v, r.i) for r in group] == sorted(((v, i) for x, v, i in rows if x == g), key=lambda p: (-p[0], p[1]))
    assert numbered(df.limit(0), ["v"]).count() == 0
    unpartitioned = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange SinglePartition" in line]
    assert unpartitioned == []


def test_insert_new_moves_whole_rows_only_to_leave_some_out(spark, tmp_path, monkeypatch):
    table = DatedTable(spark, str(tmp_path / "t"), SCHEMA, ("id",))
    moved, new_rows = [], DatedTable.new_rows
    monkeypatch.setattr(DatedTable, "new_rows", lambda self, *a: moved.append(1) or new_rows(self, *a))
    batch = rows(spark, (1, "2024-01-01", "a"), (2, "2024-01-02", "b"), (None, "2024-01-02", "n"))
    # All new, nothing but known (a null key is never known), all new beside stored rows, none at all.
    assert table.insert_new(batch, "id") == (3, 3) and not moved
    assert table.insert_new(batch.filter("id is not null"), "id") == (2, 0) and not moved
    assert table.insert_new(rows(spark, (3, "2024-01-02", "c")), "id") == (1, 1) and not moved
    assert table.insert_new(batch.limit(0), "id") == (0, 0) and not moved
    # Some known, and a key that comes twice.
    assert table.insert_new(rows(spark, (3, "2024-01-02", "x"), (4, "2024-01-02", "d")), "id") == (2, 1) and len(moved) == 1
    assert table.insert_new(rows(spark, (5, "2024-01-05", "e"), (5, "2024-01-05", "f")), "id") == (2, 1) and len(moved) == 2
    assert sorted((r.id or 0, r.v) for r in table.read().filter("v <> 'e' and v <> 'f'").collect()) == [(0, "n"), (1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_many_new_rows_are_on_disk_once(spark, tmp_path, monkeypatch):
    from fairlead.sources import tables

    table = DatedTable(spark, str(tmp_path / "t"), SCHEMA, ("id",))
    appended, append = [], DatedTable.append
    monkeypatch.setattr(DatedTable, "append", lambda self, fresh: appended.append(1) or append(self, fresh))
    batch = rows(spark, (1, "2024-01-01", "a"), (2, "2024-01-02", "b"), (None, "2024-01-02", "n"))
    batch = batch.unionByName(spark.createDataFrame([(9, None, "t")], SCHEMA))
    assert table.insert_new(batch, "id") == (4, 4) and len(appended) == 1
    monkeypatch.setattr(tables, "MOVE_BYTES", 1)
    # Staged files become those of the table: into a date that is there, a new one, and the rows without a date.
    more = rows(spark, (3, "2024-01-02", "c"), (4, "2024-01-04", "d")).unionByName(spark.createDataFrame([(8, None, "u")], SCHEMA))
    assert table.insert_new(more, "id") == (3, 3) and len(appended) == 1
    # Repeated, and partly known: whole rows are looked at.
    assert table.insert_new(more.filter("timestamp is not null"), "id") == (2, 0) and len(appended) == 1
    assert table.insert_new(rows(spark, (4, "2024-01-04", "x"), (5, "2024-01-04", "e")), "id") == (2, 1) and len(appended) == 2
    got = sorted((r.id or 0, r.v, str(r[DATE])) for r in table.read().collect())
    assert got == [
        (0, "n", "2024-01-02"), (1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", "2024-01-02"), (4, "d", "2024-01-04"),
        (5, "e", "2024-01-04"), (8, "u", "None"), (9, "t", "None"),
    ]
    # A column to order by that the table does not keep.
    ordered = rows(spark, (6, "2024-01-06", "f"), (7, "2024-01-06", "g")).withColumn("place", F.col("id") * 2)
    assert table.insert_new(ordered, "place") == (2, 2) and table.read().columns == ["id", "timestamp", "v", DATE]


def test_keys_that_cannot_repeat_are_not_grouped(spark, tmp_path, monkeypatch):
    from fairlead.operators import encounters
    from fairlead.streaming import stages
    from fairlead.streaming.store import Store

    told, insert_new = [], DatedTable.insert_new
    monkeypatch.setattr(DatedTable, "insert_new", lambda self, *a, distinct=False, **k: told.append(distinct) or insert_new(self, *a, distinct=distinct, **k))
    at = datetime(2024, 1, 1)
    state = "mmsi string, id bigint, timestamp timestamp, latitude double, longitude double, sog double, cog double"
    for number, (ids, want) in enumerate((((1, 2, 3), True), ((1, 2, 2), False))):
        snapshot = spark.createDataFrame([(f"20000000{i}", n, at, 40.0, -70.0 + i / 1000, 5.0, 90.0) for i, n in enumerate(ids)], state)
        store = Store(spark, str(tmp_path / str(number)))
        result = stages._store_encounters(store, snapshot, encounters.encounter_records(snapshot))
        # With one number for two reports two of the three pairs have one key.
        assert told.pop() == want and (result.processed, result.created) == (3, 3 if want else 2)
        assert store.encounters.read().count() == result.created
