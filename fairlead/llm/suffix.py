r"""Removal of repeated byte strings by suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier:
in a document with a smaller id, or earlier in the same document.

1. Keys. The key of a start is the smallest hash of the ``GRAM``-byte strings in
   its window of LENGTH bytes, so equal windows have equal keys. Keys that occur
   more than once are kept as flags in a bit filter of fixed size.
2. Shards. Documents are gathered, in order of ids, into shards of less than
   ``SHARD`` bytes; a longer document spans several, overlapping by a window.
   A shard's suffix array is refined by doubling (Larsson and Sadakane: only
   groups that are not sorted yet are sorted again, by the rank of what follows)
   until windows are told apart, and common prefixes of neighbours come from
   Kasai's lemma: one suffix further they are one byte shorter, so only chain
   ends are compared. Windows that start earlier in the shard are settled here.
3. Merging. Of the other windows those with a repeated key leave the shard, as
   pieces of text that cover successive windows of one key. Pieces are dealt out
   by key and sorted by key, document and start. Each task merges runs in that
   order: a window is looked up by binary search among the windows of its key so
   far. Keys of very many pieces are dealt to several tasks, each of which
   minds its share of the windows.

Texts are moved once, to meet their spans. The filter only lets too many pieces
pass when it fills up, never too few. A shard takes what its task reads next, so
shards differ between runs, but the result does not.

Defined results: null is the empty text. Rows without an id are left whole and
settle nothing. Rows of one id with different texts are documents of their own,
in order of a hash of the text. Equal rows are one document and get equal
results. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, scope, stored, table
from fairlead.llm.tokens import buffers, flag_words, list_array, mix, small_batches, window_hashes

LENGTH = 100
GRAM = 32
_POSITION_BITS = 21
#: At most 2**_POSITION_BITS - 2; half of that keeps a worker below 300 MB.
SHARD = 1 << 20
FILTER_BITS = 1 << 26
#: Pieces of one key that one task merges; more are shared out.
MOST_PIECES = 1 << 16
_SECOND_BASE = 0xD1342543DE82EF95
_PIECES = "key bigint, doc bigint, version bigint, start bigint, stop bigint, bytes binary"
_SPANS = "doc bigint, version bigint, start bigint, stop bigint"


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, and whether each shares them with the one before."""
    n = len(data)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    width = max(1, int(len(used)).bit_length())
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    symbols = np.zeros(n + 64, np.uint64)
    symbols[:n] = code[data]
    h = (63 - _POSITION_BITS) // width
    keys = np.zeros(n, np.uint64)
    for k in range(h):
        keys = (keys << np.uint64(width)) | symbols[k : k + n]
    bits, low = np.uint64(_POSITION_BITS), np.uint64((1 << _POSITION_BITS) - 1)
    keys = np.sort((keys << bits) | np.arange(n, dtype=np.uint64))
    sa = (keys & low).astype(np.int64)
    slots = np.arange(n)
    group = np.zeros(n, np.int64)
    rank = np.zeros(n + depth * 2 + 2, np.uint64)
    same = np.zeros(n, bool)
    known = h
    while True:
        # Groups are named by their first slot.
        high = keys >> bits
        fresh = np.empty(len(slots), bool)
        fresh[:1], fresh[1:] = True, high[1:] != high[:-1]
        group[slots] = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[sa[slots]] = (group[slots] + 1).astype(np.uint64)
        if h >= depth:
            border = slots[fresh]
            same[slots[~fresh]] = True
            # Neighbours that parted in this round may still share ``depth`` bytes.
            border = border[border > 0]
            border = border[before[border] == before[border - 1]] if known < depth and known != h else border[:0]
            same[border] = common_prefix(data, sa[border], sa[border - 1], depth) >= depth
            return sa, same
        open_ = np.zeros(len(slots), bool)
        open_[1:] |= ~fresh[1:]
        open_[:-1] |= ~fresh[1:]
        slots = slots[open_]
        before = group.copy() if 2 * h >= depth else group
        position = sa[slots]
        known, following = h, rank[position + h]
        keys = np.sort((group[slots].astype(np.uint64) << bits + bits) | (following << bits) | position.astype(np.uint64))
        sa[slots] = (keys & low).astype(np.int64)
        h *= 2


def common_prefix(data: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, at least up to ``limit``.

    The pair one byte on in both suffixes has one byte less in common, so a chain
    of such pairs takes its lengths from its last one.
    """
    order = np.argsort(left)
    a, b = left[order], right[order]
    last = np.ones(len(a), bool)
    last[:-1] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    ends = np.flatnonzero(last)
    lengths = np.zeros(len(ends), np.int64)
    alive = np.arange(len(ends))
    for step in range(limit):
        x, y = a[ends[alive]] + step, b[ends[alive]] + step
        inside = np.maximum(x, y) < len(data)
        alive, x, y = alive[inside], x[inside], y[inside]
        alive = alive[data[x] == data[y]]
        lengths[alive] = step + 1
    own_end = np.searchsorted(ends, np.arange(len(a)))
    out = np.empty(len(a), np.int64)
    out[order] = lengths[own_end] + ends[own_end] - np.arange(len(a))
    return out


def repeated_starts(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Flags of valid starts whose window also begins at an earlier valid start."""
    repeated = np.zeros(len(data), bool)
    sa, same = suffix_array(data, LENGTH)
    member = same.copy()
    member[:-1] |= same[1:]
    slots = np.flatnonzero(member)
    run, position = np.cumsum(~same)[slots], sa[slots]
    run, position = run[valid[position]], position[valid[position]]
    keys = np.sort((run.astype(np.uint64) << np.uint64(_POSITION_BITS)) | position.astype(np.uint64))
    run, position = keys >> np.uint64(_POSITION_BITS), (keys & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    repeated[position[1:][run[1:] == run[:-1]]] = True
    return repeated


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach, lowest = 1, values
    while reach * 2 <= width:
        lowest = np.minimum(lowest[:-reach], lowest[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(lowest[:-rest], lowest[rest:]) if rest else lowest


def window_keys(data: np.ndarray) -> np.ndarray:
    """Smallest hash of the GRAM-byte strings within the window of every start that has one."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64)
    return _sliding_min(window_hashes(data, GRAM), LENGTH - GRAM + 1)


class _Shards:
    """Gathers the documents of a task into shards, in order of ids inside each."""

    def __init__(self, batches: Iterator[pa.RecordBatch], most: int) -> None:
        self.batches, self.most = batches, most

    def __iter__(self):
        """(bytes, valid flags, begins of the parts, their doc, version and first offset)."""
        parts, size = [], 0
        for batch in self.batches:
            data, offsets = buffers(batch.column("text"))
            docs, versions = (batch.column(c).to_numpy() for c in ("doc", "version"))
            for k in range(len(docs)):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                at = 0
                while end - begin - at >= LENGTH:
                    take = min(end - begin - at, self.most)
                    if size + take > self.most and size:
                        yield self._joined(parts)
                        parts, size = [], 0
                    parts.append((int(docs[k]), int(versions[k]), at, data[begin + at : begin + at + take]))
                    size += take
                    # The next part repeats what windows that begin in this one lack.
                    at += take - LENGTH + 1
        if parts:
            yield self._joined(parts)

    @staticmethod
    def _joined(parts: list):
        # Equal rows are one document.
        parts = [p for _, p in sorted({p[:3]: p for p in parts}.items())]
        lengths = np.array([len(p[3]) for p in parts])
        begins = np.cumsum(lengths) - lengths
        data = np.concatenate([p[3] for p in parts])
        valid = np.zeros(len(data) + 1, np.int64)
        valid[begins] += 1
        valid[begins + lengths - LENGTH + 1] -= 1
        docs, versions, firsts = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        return data, np.cumsum(valid[:-1]) > 0, begins, docs, versions, firsts


def _key_counts(shard: int):
    """Distinct keys of a shard with how often a run of starts has them (2: more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, valid, *_ in _Shards(batches, shard):
            keys = window_keys(data)
            valid = valid[: len(keys)]
            first = valid.copy()
            first[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1]
            found, times = np.unique(keys[first], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], ["key", "times"]
            )

    return run


def _flag(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64(FILTER_BITS - 1)


def _flag_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, bits = flag_words(_flag(batch.column(0).to_numpy().view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], ["word", "bits"])


def repeated_keys(docs: DataFrame, shard: int = SHARD) -> np.ndarray:
    """Packed flags, by the low bits of a key, of keys that occur more than once."""
    counts = docs.mapInArrow(_key_counts(shard), "key bigint, times int")
    repeated = counts.groupBy("key").agg(F.sum("times").alias("times")).filter("times > 1").select("key")
    words = repeated.mapInArrow(_flag_words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = stored(words).toArrow()
    packed = np.zeros(FILTER_BITS // 64, np.int64)
    packed[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return packed


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions of runs of flags that no break begins inside."""
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1] | breaks[1:]
    last[:-1] &= ~flags[1:] | breaks[1:]
    return np.flatnonzero(first), np.flatnonzero(last)


def _shard_rows(packed, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = packed.value.view(np.uint8)
        for data, valid, begins, docs, versions, firsts in _Shards(batches, shard):
            repeated = repeated_starts(data, valid)
            keys = window_keys(data)
            n = len(keys)
            border = np.zeros(len(data), bool)
            border[begins] = True
            place = _flag(keys)
            wanted = (flags[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1
            wanted = wanted.astype(bool) & valid[:n] & ~repeated[:n]
            change = border[:n].copy()
            change[1:] |= keys[1:] != keys[:-1]
            for first, last, leave in ((*_runs(wanted, change), True), (*_runs(repeated, border), False)):
                part = np.searchsorted(begins, first, side="right") - 1
                shift = firsts[part] - begins[part]
                if leave:
                    texts = pa.array([data[a : b + LENGTH].tobytes() for a, b in zip(first, last)], pa.binary())
                    key = pa.array(keys[first].view(np.int64))
                else:
                    texts, key = pa.nulls(len(first), pa.binary()), pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(docs[part]), pa.array(versions[part]), pa.array(first + shift),
                     pa.array(last + LENGTH + shift), texts],
                    ["key", "doc", "version", "start", "stop", "bytes"],
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that came before; rows are sorted by key and share, then document and start."""
    seen_key, seen = None, tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    for batch in batches:
        data, offsets = buffers(batch.column("bytes"))
        if not len(data):
            continue
        key, share, shares, doc, version, start = (
            batch.column(c).to_numpy() for c in ("key", "share", "shares", "doc", "version", "start")
        )
        starts = np.diff(offsets) - LENGTH + 1
        piece = np.repeat(np.arange(len(starts)), starts)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = offsets[piece] + inside
        one, two = window_hashes(data, LENGTH)[at], window_hashes(data, LENGTH, _SECOND_BASE)[at]
        mine = (one >> np.uint64(32)) % shares[piece].astype(np.uint64) == share[piece].astype(np.uint64)
        name = mix(key.view(np.uint64) + np.uint64(1))[piece] ^ one
        where = (doc[piece], version[piece], start[piece] + inside)
        repeated = np.zeros(len(piece), bool)
        # Windows of the key that the last batch ended with: search among those it had so far.
        head = np.flatnonzero(key[piece] == seen_key) if len(seen[0]) else np.zeros(0, np.int64)
        if len(head):
            slot = np.minimum(np.searchsorted(seen[0], name[head]), len(seen[0]) - 1)
            # A copy of the same row is no repetition of it.
            own = np.logical_and.reduce([seen[2 + i][slot] == where[i][head] for i in range(3)])
            repeated[head] = (seen[0][slot] == name[head]) & (seen[1][slot] == two[head]) & ~own
        order = np.argsort(name, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (two[order][1:] != two[order][:-1])
        lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        repeated[order[np.logical_or.reduce([w[order] != w[lead] for w in where])]] = True
        repeated &= mine
        breaks = np.zeros(len(piece), bool)
        breaks[np.cumsum(starts) - starts] = True
        first, last = _runs(repeated, breaks)
        if len(first):
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[0][first]), pa.array(where[1][first]), pa.array(where[2][first]),
                 pa.array(where[2][last] + LENGTH)],
                ["doc", "version", "start", "stop"],
            )
        # Earlier windows stand first, so each name keeps its earliest place.
        tail = np.flatnonzero((key[piece] == key[-1]) & mine)
        newest = (name[tail], two[tail], *(w[tail] for w in where))
        if key[-1] == seen_key:
            newest = tuple(np.concatenate(pair) for pair in zip(seen, newest))
        _, index = np.unique(newest[0], return_index=True)
        seen_key, seen = key[-1], tuple(column[index] for column in newest)


def repeated_spans(docs: DataFrame, shard: int = SHARD, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Rows doc, version, start, stop (may overlap) of bytes to remove, for rows doc, version, text."""
    known = docs.filter("doc IS NOT NULL").select("doc", "version", "text")
    packed = docs.sparkSession.sparkContext.broadcast(repeated_keys(known, shard))
    rows = stored(known.mapInArrow(_shard_rows(packed, shard), _PIECES))
    pieces = rows.filter("key IS NOT NULL")
    crowded = pieces.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most_pieces)
    crowded = crowded.select("key", F.ceil(F.col("n") / most_pieces).cast("int").alias("many"))
    dealt = pieces.join(crowded, "key", "left").withColumn("shares", F.coalesce("many", F.lit(1))).drop("many")
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = dealt.repartition("key", "share").sortWithinPartitions("key", "share", "doc", "version", "start")
    merged = dealt.select("key", "share", "shares", "doc", "version", "start", "bytes").mapInArrow(_merge, _SPANS)
    return rows.filter("key IS NULL").select("doc", "version", "start", "stop").unionByName(merged)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        data, offsets = buffers(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        sizes, removed, runs, kept, where = [], [], [], [], []
        for k, own in enumerate(spans):
            text = data[offsets[k] : offsets[k + 1]]
            gone = np.zeros(len(text) + 1, np.int64)
            if own:
                np.add.at(gone, [s["start"] for s in own], 1)
                np.add.at(gone, [s["stop"] for s in own], -1)
            flags = np.cumsum(gone[:-1]) > 0
            first, last = _runs(flags, np.zeros(len(flags), bool)) if own else (np.zeros(0, np.int64),) * 2
            sizes.append(len(text))
            removed.append(int(flags.sum()) if own else 0)
            runs.append(len(first))
            kept.append((text[~flags] if own else text).tobytes())
            where.append(np.stack([first, last + 1], axis=1).ravel().astype(np.int64))
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
             list_array(where, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"],
        )


_RESULT = (
    "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<bigint>, kept_sha256 string, kept binary"
)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard: int = SHARD,
    most_pieces: int = MOST_PIECES,
) -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, spans (begin and end by turns), kept_sha256, kept (bytes)."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("version", F.xxhash64("text"))
    with scope(docs.sparkSession):
        spans = repeated_spans(rows, shard, most_pieces).groupBy("doc", "version")
        spans = stored(spans.agg(F.collect_list(F.struct("start", "stop")).alias("spans")), outer=True)
    joined = rows.join(spans, ["doc", "version"], "left")
    return joined.select(F.col("doc").alias("id"), "text", "spans").mapInArrow(_apply, _RESULT)


@query("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
