"""Report files under any name, on any file system, changed at any time."""

import hashlib
import os

import pytest

from test_streaming import HEADER, inbox, lines, put, store  # noqa: F401

from fairlead.sources import files, paths
from fairlead.streaming import folder, ingest

ODD = ["day 1.csv", "a#b.csv", "what?.csv", "x%20y.csv", "100%.csv", "list[1].csv", "set{1,2}.csv", "é ü.csv", "plus+&=.csv", "all*.csv"]


def test_places_of_paths():
    assert paths.locate("file:/tmp/a b#c?d%20.csv")[1] == "/tmp/a b#c?d%20.csv"
    assert paths.locate("file:///tmp/x")[1] == paths.locate("/tmp/x")[1] == "/tmp/x"
    assert paths.parts("s3a://bucket/in box/a#b.csv") == ("s3://bucket/", "/in box/a#b.csv")
    assert paths.parts("hdfs://name:8020/x?y") == ("hdfs://name:8020/", "/x?y")
    assert not paths.can_open("viewfs://store/in") and paths.can_open("S3A://b/x")
    with pytest.raises(ValueError, match="viewfs"):
        paths.locate("viewfs://store/in")


def test_odd_names_are_digested_and_imported(spark, store, inbox):  # noqa: F811
    for i, name in enumerate(ODD):
        put(inbox, name, HEADER + lines(f"1111111{i:02}", 0, 2))
    # What a pattern or a fragment would find instead.
    put(inbox, "a", "x")
    put(inbox, "whatX.csv", HEADER + lines("222222222", 0, 3))
    got = {r.name: r for r in files.file_digests(spark, str(inbox)).collect()}
    assert sorted(got) == sorted([*ODD, "whatX.csv"])
    for name, row in got.items():
        assert row.content_sha256 == hashlib.sha256((inbox / name).read_bytes()).hexdigest() and row.error is None
    jobs = ingest.ingest_directory(store, str(inbox), stages=None)
    assert [j.status for j in jobs] == ["completed"] * 11
    assert sorted(j.rows_imported for j in jobs) == [2] * 10 + [3]
    assert store.messages.read().count() == 23


def test_one_unreadable_file_fails_alone(spark, store, inbox):  # noqa: F811
    put(inbox, "good.csv", HEADER + lines("111111111", 0, 3))
    put(inbox, "gone.csv", HEADER + lines("222222222", 0, 3))
    listed = spark.createDataFrame(files.list_files(spark, str(inbox)).drop("file_uri").collect())
    os.remove(inbox / "gone.csv")
    digests = listed.mapInArrow(files._digest_files, files.DIGESTS)
    jobs = {j.source_file.rsplit("/", 1)[1]: j for j in ingest.ingest_batch(store, digests, None)}
    assert jobs["good.csv"].status == "completed" and jobs["gone.csv"].status == "failed"
    assert "No such file" in jobs["gone.csv"].error_message
    # Still gone: it stays failed under the same identity. Back again: it is imported, and the failure is closed.
    again = ingest.retry_failed(store, stages=None)
    assert [(j.job_id, j.status) for j in again] == [(jobs["gone.csv"].job_id, "failed")]
    put(inbox, "gone.csv", HEADER + lines("222222222", 0, 3))
    assert [j.status for j in ingest.retry_failed(store, stages=None)] == ["completed"]
    assert ingest.retry_failed(store, stages=None) == []
    assert store.messages.read().count() == 6


def test_digests_through_spark_readers_only(spark, inbox):  # noqa: F811
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./in", f"file://{inbox}")
    contents = {
        "end.csv": b"mmsi,x\r\n1,2\n", "open.csv": b"mmsi\n1", "breaks.csv": b"\n\n\r\n",
        "bytes.csv": b"a,\xff\xfe\x00b\n\xe9\n", "long.csv": b"h\n" + b"0123456789\n" * 200_000, "day 1.csv": b"x\n",
    }
    for name, data in contents.items():
        (inbox / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # A file in several splits, several files in a split.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        found = files.file_digests(spark, "viewfs://store/in")
        got = {r.name: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {n: r.content_sha256 for n, r in got.items()} == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    assert got["end.csv"].header == "mmsi,x"
    assert "content#" not in found._jdf.queryExecution().executedPlan().toString()
    listed = files.digest_paths(spark, {"viewfs://store/in/end.csv": 1, "viewfs://store/in/none.csv": 1}).collect()
    assert [r.name for r in listed] == ["end.csv"]


def offers(spark, tmp_path):
    return sorted((r.name, r.size_bytes) for r in spark.read.parquet(str(tmp_path / "seen")).collect())


def run(spark, inbox, tmp_path):  # noqa: F811
    stream = folder.changed_files(spark, str(inbox), str(tmp_path / "cp" / "offered")).writeStream.format("parquet")
    stream = stream.option("path", str(tmp_path / "seen")).option("checkpointLocation", str(tmp_path / "cp"))
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.isActive


def test_stream_offers_changed_files_again(spark, inbox, tmp_path, monkeypatch):  # noqa: F811
    put(inbox, "a.csv", "x")
    put(inbox, ".b.csv", "y")
    put(inbox, "_c.csv", "y")
    put(inbox, "d.txt", "y")
    run(spark, inbox, tmp_path)
    assert offers(spark, tmp_path) == [("a.csv", 1)]
    put(inbox, "c 1.csv", "z")
    run(spark, inbox, tmp_path)
    run(spark, inbox, tmp_path)
    assert offers(spark, tmp_path) == [("a.csv", 1), ("c 1.csv", 1)]
    put(inbox, "a.csv", "longer")
    os.utime(inbox / "c 1.csv", ns=(10**18, 10**18))
    run(spark, inbox, tmp_path)
    expected = [("a.csv", 1), ("a.csv", 6), ("c 1.csv", 1), ("c 1.csv", 1)]
    assert offers(spark, tmp_path) == expected
    os.remove(inbox / "a.csv")
    run(spark, inbox, tmp_path)
    assert offers(spark, tmp_path) == expected


def test_change_while_the_stream_runs_is_imported(spark, store, inbox, tmp_path):  # noqa: F811
    put(inbox, "a b.csv", HEADER + lines("111111111", 0, 3))
    query = ingest.start_ingestion(store, str(inbox), str(tmp_path / "cp"), None, processingTime="0 seconds")
    try:
        def wait(count):
            for _ in range(300):
                query.exception() and pytest.fail(str(query.exception()))
                if store.registry.jobs().filter("analytics_status IS NOT NULL").count() == count:
                    return
                query.awaitTermination(0.5)
            pytest.fail(f"not {count} jobs done")

        wait(1)
        put(inbox, ".new", HEADER + lines("111111111", 0, 5))
        os.replace(inbox / ".new", inbox / "a b.csv")
        wait(2)
    finally:
        query.stop()
    assert store.messages.read().count() == 5
    jobs = store.registry.jobs().orderBy("rows_read").collect()
    assert [(j.rows_read, j.rows_imported, j.status) for j in jobs] == [(3, 3, "completed"), (5, 2, "completed")]


def test_offer_log_is_put_together(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "COMPACT_AFTER", 3)
    inbox_, log = tmp_path / "in", str(tmp_path / "log")
    inbox_.mkdir()
    reader = folder.FolderReader(str(inbox_), "*.csv", log)
    assert reader.latestOffset() == {"entry": 0}
    for i in range(7):
        (inbox_ / f"{i}.csv").write_text("x")
        if i == 4:
            os.remove(inbox_ / "0.csv")
        assert reader.latestOffset() == {"entry": i + 1}
        part = reader.partitions({"entry": i}, {"entry": i + 1})
        assert [f[0] for p in part for f in p.files] == [f"{inbox_}/{i}.csv"]
        reader.commit({"entry": i + 1})
    names = {p.name for p in (tmp_path / "log").iterdir()}
    assert "6.all" in names and "2.json" not in names and "3.all" not in names
    # A new reader knows what was offered; an entry that was written but never read is still there.
    again = folder.FolderReader(str(inbox_), "*.csv", log)
    assert again.latestOffset() == {"entry": 7} and set(again.seen) == set(reader.seen)
    rows = list(again.read(again.partitions({"entry": 6}, {"entry": 7})[0]))
    assert rows[0][1] == "6.csv" and rows[0][4] == hashlib.sha256(b"x").hexdigest()
    (inbox_ / "0.csv").write_text("x")
    assert again.latestOffset() == {"entry": 8}
