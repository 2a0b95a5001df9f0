r"""Web archives (WARC) written and read as tables of record chunks.

A payload travels as rows (record, chunk number, at most ``CHUNK`` bytes), so no
task holds a record as a whole besides its input row. Writing streams the chunks
of a partition into one ``.warc.gz`` file (a gzip member per record) in the
shared folder, under a name of its own per attempt; the returned manifest lists
the files of finished attempts only, so a repeated task leaves at most an
unlisted file. Reading streams each listed file and yields the chunk rows again
with the digest of the payload so far, carried from chunk to chunk.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
smallest page id is a response and the others are revisits of it. Payloads are
equal when length and SHA-1 are. Equal payloads are found on rows of id and
digest; minima are combined before the shuffle and a payload that very many
pages share is split by Spark's skew handling.

Archives of other writers are read too, as ``.warc.gz`` or plain ``.warc``:
records of the types ``response``, ``revisit``, ``resource`` and ``conversion``
give rows, all others (``warcinfo``, ``request``, ``metadata``, ...) are passed
over by their length. Ids stay texts in ``record_id`` and ``refers_to_record``;
``page_id`` and ``refers_to`` are filled where they are ids of this writer. An
HTTP head is split off where the content type or the record type says so and the
block has one within ``HEAD`` bytes; the payload is the rest as it was sent, so
chunked or compressed transfers stay so. Its length is counted, not believed; of
a revisit it is what the HTTP head says, else null. A digest is compared if it
is a SHA-1 in base 32 and neither a transfer coding nor a truncation explains a
difference.

Defined results: a null html is an empty payload. A row without a page id is a
response. Rows that share id and payload get the same record type. A null url
leaves the target header out. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, stored, table
from fairlead.session import scratch_path
from fairlead.sources.paths import locate

CHUNK = 1 << 20
#: Bytes within which the head of a record and its HTTP head must end.
HEAD = 1 << 20
_KINDS = ("response", "revisit", "resource", "conversion")
_MANIFEST = "archive string, bytes bigint, records bigint"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "<urn:page:{}>"
_CHUNK_COLUMNS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, chunk_no int, digest_so_far string, is_last boolean, "
    "record_id string, refers_to_record string"
)


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows page_id, url, payload, sha1, n, refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    base = base.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("bigint")})
    ids = base.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1", "n")
    firsts = ids.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.filter("first < last").select("sha1", "n", "first")
    revisits = (
        ids.join(firsts, ["sha1", "n"])
        .filter("page_id > first")
        .select("page_id", F.col("sha1").alias("sha1_r"), F.col("first").alias("refers_to"))
        .distinct()
    )
    return base.join(
        revisits.withColumnRenamed("page_id", "page_r"),
        (F.col("page_id") == F.col("page_r")) & (F.col("sha1") == F.col("sha1_r")),
        "left",
    ).select("page_id", "url", "payload", "sha1", "n", "refers_to")


def payload_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk, the chunks of a record next to each other; a revisit has one empty chunk."""
    size = F.when(F.col("refers_to").isNull(), F.col("n")).otherwise(F.lit(0))
    last = F.floor(F.greatest(size - 1, F.lit(0)) / chunk).cast("int")
    rows = records.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"), last.alias("last_no"))
    piece = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "sha1", "n", "refers_to", "chunk_no", "last_no", piece.alias("chunk"))


def _text(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _head(page_id, url, digest: str, n: int, refers_to) -> bytes:
    http = _HTTP.format(n)
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_RECORD.format('' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else n)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_text(url)}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_RECORD.format(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, written, records, path, store = None, 0, 0, "", None
        member = None
        try:
            for batch in batches:
                for page, url, sha1, n, refers, no, last, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        store, path = locate(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    if no == 0:
                        digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                        member = zlib.compressobj(1, zlib.DEFLATED, 31)
                        written += out.write(member.compress(_head(page, url, digest, n, refers)))
                    if chunk:
                        written += out.write(member.compress(chunk))
                    if no == last:
                        written += out.write(member.compress(b"\r\n\r\n") + member.flush())
                        records += 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            uri = f"{folder}/{path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"archive": [uri], "bytes": [written], "records": [records]})

    return write


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write one archive per partition; returns the stored manifest (archive, bytes, records)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = payload_chunks(with_references(pages, min_bytes), chunk)
    return stored(rows.mapInArrow(_writer(folder), _MANIFEST))


class _Bytes:
    """The content of an archive, gzip members or plain, a bounded piece at a time."""

    def __init__(self, source, piece: int) -> None:
        self.source, self.piece = source, piece
        self.buffer, self.rest = bytearray(), source.read(max(piece, 2))
        self.inflate = zlib.decompressobj(31) if self.rest[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while True:
            if self.inflate and self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.source.read(self.piece)
                if not self.rest:
                    return False
            if self.inflate:
                out = self.inflate.decompress(self.rest, self.piece)
                self.rest = self.inflate.unconsumed_tail
            else:
                out, self.rest = self.rest, b""
            if out:
                self.buffer += out
                return True

    def find(self, mark: bytes, limit: int) -> int:
        """Place of the mark that ends within ``limit`` bytes, else -1."""
        start = 0
        while (at := self.buffer.find(mark, start, limit)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if len(self.buffer) >= limit or not self._more():
                return -1
        return at

    def at_end(self) -> bool:
        return not self.buffer and not self._more()

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found


def _fields(head: bytes) -> dict[str, str]:
    """Names in lower case and values; lines without a colon are left out."""
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, colon, v in pairs if colon}


def _page(record: str | None) -> int | None:
    """Page id in a record id of this writer."""
    number = record.removeprefix("<urn:page:").removesuffix(">") if record and record.startswith("<urn:page:") else ""
    return int(number) if number.removeprefix("-").isdecimal() else None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdecimal() else None


def _base32(digest) -> str:
    return base64.b32encode(digest).decode()


def _records(source, chunk: int, payloads: bool) -> Iterator[tuple]:
    data = _Bytes(source, chunk)
    while not data.at_end():
        end = data.find(b"\r\n\r\n", HEAD)
        if end < 0:
            raise ValueError("archive ends inside a header, or the header has no end")
        head = data.take(end + 4)
        fields = _fields(head)
        here = _number(fields.get("content-length"))
        if not head.startswith(b"WARC/") or here is None:
            raise ValueError(f"no WARC record with a length where one should start: {head[:80]!r}")
        kind, record = fields.get("warc-type", ""), fields.get("warc-record-id")
        if kind in _KINDS:
            yield from _payload(data, fields, kind, record, here, chunk, payloads)
        else:
            while here:
                here -= len(data.take(min(here, chunk)))
        if data.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {record} does not end where it should")


def _payload(data: _Bytes, fields: dict, kind: str, record: str | None, here: int, chunk: int, payloads: bool) -> Iterator[tuple]:
    """Chunk rows of one record whose block of ``here`` bytes comes next."""
    http: dict[str, str] = {}
    content = fields.get("content-type", "").replace(" ", "").lower()
    if content.startswith("application/http") or (not content and kind in ("response", "revisit")):
        end = data.find(b"\r\n\r\n", min(here, HEAD))
        if end >= 0:
            http = _fields(data.take(end + 4))
            here -= end + 4
    whole = kind != "revisit"
    n = here if whole else _number(http.get("content-length"))
    method, _, named = fields.get("warc-payload-digest", "").rpartition(":")
    named = named.upper() if method.lower() in ("", "sha1") and len(named) == 32 else named or None
    exact = whole and "transfer-encoding" not in http and "warc-truncated" not in fields
    exact = exact and method.lower() == "sha1" and len(named or "") == 32
    refers = fields.get("warc-refers-to")
    same = (_page(record), fields.get("warc-target-uri"), kind, _page(refers), n, named)
    state, no, left = hashlib.sha1(), 0, here
    while True:
        piece = data.take(min(left, chunk))
        left -= len(piece)
        state.update(piece)
        so_far = _base32(state.digest())
        if not left and exact and so_far != named:
            raise ValueError(f"payload of {record} does not match its digest")
        yield (*same, no, so_far, not left, record, refers, *([piece] if payloads else []))
        no += 1
        if not left:
            return


def _reader(chunk: int, payloads: bool, rows_per_batch: int):
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    types += [pa.string(), pa.string()]
    names = [c.split()[0] for c in _CHUNK_COLUMNS.split(", ")] + ["chunk"] * payloads
    types += [pa.binary()] * payloads

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = locate(uri)
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as source:
                    for row in _records(source, chunk, payloads):
                        rows.append(row)
                        if len(rows) >= rows_per_batch:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return read


def read_archives(manifest: DataFrame, payloads: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all records; ``payloads`` adds the bytes as column ``chunk``.

    ``manifest`` lists the paths in its column ``archive``; any frame of paths will do.

    ``payload_digest`` is what the header names and ``digest_so_far`` the digest
    of the chunks up to this one; the last chunk of a response must agree.
    """
    schema = _CHUNK_COLUMNS + ", chunk binary" * payloads
    # One row per archive. A stated number keeps Spark from joining these few small rows into one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("archive").repartition(tasks, "archive")
    return files.mapInArrow(_reader(chunk, payloads, 16 if payloads else 4096), schema)


@query(
    "op7_warc",
    # DuckDB's base 32 is not at hand: five bits at a time from the hexadecimal digest.
    """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
    SELECT page_id, n, hex,
           list_reduce(list_transform(range(0, 8), lambda k:
               list_reduce(list_transform(range(0, 4), lambda j:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          CAST((CAST('0x' || substr(hex, CAST(k * 5 + 1 AS INT), 5) AS BIGINT)
                                >> CAST(15 - 5 * j AS INT)) & 31 AS INT) + 1, 1)),
                   lambda a, b: a || b)), lambda a, b: a || b) AS digest
    FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""",
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    records = read_archives(manifest, payloads=False).filter("is_last")
    whole = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", whole.alias("payload_digest"), "record_type", "refers_to")
