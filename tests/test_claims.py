from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from fairlead.sources.files import file_digests
from fairlead.streaming import claims, ingest
from fairlead.streaming.store import Store
from test_streaming import HEADER, lines


def test_one_of_many_creates_a_file(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: claims.publish(spark, f"{tmp_path}/x", f"{i}"), range(40)))
    assert sum(won) == 1 and claims._text(spark, f"{tmp_path}/x") == str(won.index(True))
    assert claims._text(spark, f"{tmp_path}/y") is None and [p.name for p in tmp_path.iterdir()] == ["x"]


def test_number_ranges_do_not_overlap(spark, tmp_path):
    path = f"{tmp_path}/ids"
    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(lambda n: (claims.next_range(spark, path, n, 7), n), [3, 1, 5, 2] * 25))
    taken = [x for first, n in firsts for x in range(first, first + n)]
    assert len(set(taken)) == len(taken) == 275 and min(taken) == 7
    assert len(list((tmp_path / "ids").glob("[0-9]*"))) <= claims.KEPT_RANGES + 8


def test_leases_end_by_release_time_or_owner(spark, tmp_path):
    one = claims.Leases(spark, f"{tmp_path}/l", "one", 3600)
    two = replace(one, owner="two")
    assert one.take(["a", "b"]) == ["a", "b"] and two.take(["a", "b", "c"]) == ["c"]
    assert sorted(two.of_others()) == ["a", "b"] and one.take(["a"]) == ["a"]
    two.release(["a", "b"])
    assert sorted(two.of_others()) == ["a", "b"]
    one.release(["a"])
    late = replace(two, seconds=0)
    assert late.take(["b"]) == ["b"] and one.take(["b"]) == []
    one.release(["b"])
    assert one.of_others() and "b" in one.of_others()


def test_two_drivers_import_every_row_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.csv").write_text(HEADER + lines(f"{111111111 + i}", 0, 5))
    stores = [Store(spark, str(tmp_path / "store")) for _ in range(2)]
    offered = [file_digests(spark, str(inbox)) for _ in stores]
    with ThreadPoolExecutor(2) as pool:
        claimed = list(pool.map(lambda s, f: s.registry.claim(f, 256), stores, offered))
    assert sorted(j.source_file[-5:] for jobs in claimed for j in jobs) == ["0.csv", "1.csv", "2.csv"]
    with ThreadPoolExecutor(2) as pool:
        firsts = list(pool.map(lambda s, jobs: s.registry.reserve(jobs, 15)[1], stores, claimed))
    assert abs(firsts[0] - firsts[1]) >= 15
    # What another driver holds is left to it; once released it is open again.
    assert ingest.ingest_batch(Store(spark, stores[0].root), offered[0], stages=None) == []
    for store, jobs in zip(stores, claimed):
        store.registry.release(jobs)
    done = ingest.ingest_batch(stores[0], offered[0], stages=None)
    assert sum(j.rows_imported for j in done) == 15 and stores[0].registry.leases.of_others() == []
    ids = [r.id for r in stores[0].messages.read().collect()]
    assert len(set(ids)) == 15 and min(ids) >= 30
    assert stores[1].registry.claim(offered[1], 256) == []
