import base64
import hashlib
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from fairlead.llm import line_dedup, warc

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected_lines(rows, min_chars=40, min_documents=5):
    key = lambda line: lower(line.strip(SPACE))
    holders = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(i)
    newest = {k: max(v) for k, v in holders.items() if len(v) >= min_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or i >= newest.get(key(x), i)]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_lines_against_brute_force(spark):
    rows = cases.texts()
    got = line_dedup.dedup_lines(cases.frame(spark)).select("doc_id", "_n_lines", "_n_dropped", "text").collect()
    assert order(map(tuple, got)) == order(expected_lines(rows))
    assert sum(r[2] for r in expected_lines(rows)) > 5


def test_lines_keep_columns_and_empty_tables(spark):
    out = line_dedup.dedup_lines(cases.empty(spark))
    assert out.count() == 0
    one = line_dedup.dedup_lines(cases.frame(spark, [(1, None)])).first()
    assert one["version"] == "clash" and one["words"] == 7 and one["text"] is None and one["_n_lines"] == 1


def test_lines_slices_add_up(spark, monkeypatch):
    # One key over many slices of ids, and a document with more lines than a bitmap word.
    rows = [(i * 3000, cases.LINE + "\n" + f"own {i}") for i in range(40)]
    rows.append((7, "\n".join([cases.LINE, "x"] * 100)))
    got = line_dedup.dedup_lines(cases.frame(spark, rows)).select("doc_id", "_n_lines", "_n_dropped", "text").collect()
    assert order(map(tuple, got)) == order(expected_lines(rows))


def test_bitmaps_hold_no_text(spark):
    bitmaps = line_dedup.drop_bitmaps(cases.frame(spark))
    assert bitmaps.columns == ["doc", "version", "words"]
    assert {r["doc"] for r in bitmaps.collect()} == {r[0] for r in expected_lines(cases.texts()) if r[2]}


PAGES = [
    (1, "http://a/", "same"),
    (2, "http://b/\r\nX: y", "same"),
    (2, "http://b/\r\nX: y", "same"),
    (3, None, ""),
    (4, "u", None),
    (5, "ü", "é" * 2500),
    (None, "n", "same"),
    (6, "u", "WARC/1.1\r\n\r\n" * 400),
    (0, "z", "late"),
    (9, "z", "late"),
]


def pages(spark, rows=PAGES):
    full = [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, html string, payload string, n int").repartition(3)


def test_warc_round_trip_in_small_chunks(spark):
    manifest = warc.write_archives(pages(spark), chunk=100)
    chunks = warc.read_archives(manifest, chunk=100).collect()
    whole = defaultdict(dict)
    for c in chunks:
        assert len(c["chunk"]) <= 100
        whole[c["page_id"], c["record_type"], c["url"]].setdefault(c["chunk_no"], c)
    texts = {(i, u): (t or "").encode() for i, u, t in PAGES}
    for (page, kind, _), parts in whole.items():
        parts = [parts[k] for k in sorted(parts)]
        payload = b"".join(p["chunk"] for p in parts)
        assert [p["is_last"] for p in parts] == [False] * (len(parts) - 1) + [True]
        state = hashlib.sha1()
        for p in parts:
            state.update(p["chunk"])
            assert p["digest_so_far"] == base64.b32encode(state.digest()).decode()
        expected = next(t for (i, u), t in texts.items() if i == page)
        assert payload == (expected if kind == "response" else b"")
        assert parts[0]["payload_bytes"] == len(expected)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)


def test_warc_references(spark):
    records = warc.read_archives(warc.write_archives(pages(spark)), payloads=False)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in records.filter("is_last").collect()}
    assert got == {
        (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None),
        (None, "response", None), (6, "response", None), (0, "response", None), (9, "revisit", 0),
    }
    high = warc.read_archives(warc.write_archives(pages(spark), min_bytes=5), payloads=False)
    assert high.filter("record_type = 'revisit'").count() == 0


def test_warc_headers_stay_on_one_line(spark):
    urls = {r["url"] for r in warc.read_archives(warc.write_archives(pages(spark))).collect()}
    assert "http://b/%0D%0AX: y" in urls and None in urls


def test_warc_empty_and_damaged(spark, tmp_path):
    assert warc.read_archives(warc.write_archives(pages(spark, [(None, None, None)]).limit(0))).count() == 0
    manifest = warc.write_archives(pages(spark), folder=f"file://{tmp_path}")
    uri = manifest.first()["archive"]
    path = uri.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside"):
        warc.read_archives(manifest).collect()


def test_warc_files_are_gzip_members(spark, tmp_path):
    import gzip

    manifest = warc.write_archives(pages(spark), folder=f"file://{tmp_path}")
    text = b"".join(gzip.open(r["archive"].removeprefix("file://")).read() for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and text.endswith(b"\r\n\r\n")
    assert sum(r["bytes"] for r in manifest.collect()) == sum(f.stat().st_size for f in tmp_path.glob("*.warc.gz"))


def foreign(kind, headers, block, end=b"\r\n\r\n"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + end


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


BODY = b"<p>hello</p>\r\n\r\n" * 30
FOREIGN = [
    foreign("warcinfo", ["Content-Type: application/warc-fields"], b"software: other\r\n\r\n" * 20),
    foreign("request", ["WARC-Record-ID: <urn:uuid:0>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
    foreign(
        "response",
        ["WARC-Record-ID: <urn:uuid:1f-a>", "WARC-Target-URI: http://x/", f"WARC-Payload-Digest: sha1:{sha1(BODY)}",
         "Content-Type: application/http; msgtype=response"],
        b"HTTP/1.1 200 OK\r\nno colon here\r\nX: \xff\r\n\r\n" + BODY,
    ),
    foreign("response", ["WARC-Record-ID: <urn:uuid:2>", f"WARC-Payload-Digest: sha1:{sha1(b'hello')}"],
            b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9999\r\n\r\n5\r\nhello\r\n0\r\n\r\n"),
    foreign("response", ["WARC-Record-ID: <urn:uuid:3>", "WARC-Payload-Digest: md5:00", "Content-Type: text/dns"], b"no head at all"),
    foreign("response", ["Content-Type: application/http"], b"HTTP/1.1 200 OK and no end"),
    foreign("revisit", ["WARC-Record-ID: <urn:uuid:4>", "WARC-Refers-To: <urn:uuid:1f-a>"], b""),
    foreign("resource", ["WARC-Record-ID: <urn:uuid:5>", "Content-Type: text/plain"], b"a\r\n\r\nb"),
    foreign("metadata", [], b""),
]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc_of_other_writers(spark, tmp_path, packed, chunk):
    import gzip

    path = tmp_path / ("a b#1%20.warc" + ".gz" * packed)
    path.write_bytes(b"".join(gzip.compress(r) if packed else r for r in FOREIGN))
    manifest = spark.createDataFrame([(f"file://{path}",)], "archive string")
    rows = defaultdict(list)
    for r in warc.read_archives(manifest, chunk=chunk).orderBy("chunk_no").collect():
        rows[r["record_id"]].append(r)
    got = {k: (b"".join(r["chunk"] for r in v), v[0]["payload_bytes"], v[-1]["digest_so_far"]) for k, v in rows.items()}
    uid = "<urn:uuid:{}>".format
    payloads = {
        uid("1f-a"): BODY, uid("2"): b"5\r\nhello\r\n0\r\n\r\n", uid("3"): b"no head at all",
        None: b"HTTP/1.1 200 OK and no end", uid("5"): b"a\r\n\r\nb",
    }
    assert got == {**{k: (v, len(v), sha1(v)) for k, v in payloads.items()}, uid("4"): (b"", None, sha1(b""))}
    first = rows[uid("1f-a")][0]
    assert (first["page_id"], first["url"], first["payload_digest"]) == (None, "http://x/", sha1(BODY))
    assert rows[uid("4")][0]["refers_to_record"] == uid("1f-a") and rows[uid("4")][0]["refers_to"] is None
    assert rows[uid("3")][0]["payload_digest"] == "00" and rows[uid("5")][0]["payload_digest"] is None


@pytest.mark.parametrize(
    "data, error",
    [
        (b"junk\r\n\r\n", "no WARC record"),
        (foreign("metadata", [], b"x", end=b"\r\n"), "ends inside"),
        (foreign("metadata", [], b"x", end=b"....") + FOREIGN[0], "does not end where"),
        (foreign("resource", [f"WARC-Payload-Digest: sha1:{sha1(b'y')}"], b"x"), "does not match"),
    ],
)
def test_warc_damage_is_an_error(spark, tmp_path, data, error):
    (tmp_path / "a.warc").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "archive string")
    with pytest.raises(Exception, match=error):
        warc.read_archives(manifest).collect()
