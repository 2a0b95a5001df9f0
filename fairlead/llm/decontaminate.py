r"""Benchmark passages in documents, found by q-gram counts in diagonal bands.

Texts are compared as code points with A-Z in lower case and white space runs as
one blank. An item of m characters may differ by e = floor(RATE m) edits. By the
q-gram lemma an occurrence shares at least m - q + 1 - q e of the item's q-grams,
all on diagonals (place in the text less place in the item) that lie within e of
each other. Diagonals are cut into overlapping bands of 2 (e + 1), so one band
holds them all; bands with enough hits are verified by an alignment limited to
the band. q is GRAM, or the longest for which the bound stays positive.

The benchmark is the stated query set. It is taken in blocks of about
``BLOCK_CHARS`` characters by hash of the item; each block's q-gram table goes to
all tasks, so its size is bounded whatever the benchmark's size, and every block
is held against all documents. Long texts are worked on in parts that overlap by
the longest item, so memory does not depend on them.

Defined results: null and empty items and texts match nothing. Equal rows get
equal results. Items with the same id are separate items whose matches carry
that id. Rows without an id are searched too. Other columns are not looked at by
the search and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, table
from fairlead.llm.tokens import mix, small_batches

GRAM = 12
RATE = 0.06
BLOCK_CHARS = 4_000_000
PART = 1 << 18
_HITS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FLAG_BITS = np.uint64(44)
_MATCHES = "doc bigint, item bigint, start bigint, stop bigint, edits int"


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points as they are compared, and the place of each in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    points[space] = 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return points[keep], np.flatnonzero(keep)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from every place that has as many."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    rolled, have = wide, 1
    # Doubling: the hash of 2k characters from those of k.
    total, done = None, 0
    factor = _BASE
    while True:
        if q & have:
            part = rolled[done : done + n]
            total = part if total is None else total * factor + part
            done += have
        if have * 2 > q:
            return mix(total)
        rolled = rolled[:-have] * factor + rolled[have:]
        factor = factor * factor
        have *= 2


@dataclass
class Items:
    """Benchmark items with their q-gram table, one table per q that occurs."""

    ids: list[int]
    texts: list[np.ndarray]

    def __post_init__(self) -> None:
        with np.errstate(over="ignore"):
            self.sizes = np.array([len(t) for t in self.texts], np.int64)
            self.edits = (self.sizes * RATE).astype(np.int64)
            self.grams = np.minimum(GRAM, self.sizes // (self.edits + 1))
            self.needed = self.sizes - self.grams + 1 - self.grams * self.edits
            self.tables = {}
            for q in np.unique(self.grams).tolist():
                mine = np.flatnonzero(self.grams == q)
                hashes = [gram_hashes(self.texts[i], q) for i in mine]
                owner = np.repeat(mine, [len(h) for h in hashes])
                place = np.concatenate([np.arange(len(h)) for h in hashes])
                hashes = np.concatenate(hashes)
                order = np.argsort(hashes, kind="stable")
                keys, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
                flags = np.zeros(1 << 20, bool)
                flags[keys >> _FLAG_BITS] = True
                self.tables[q] = (flags, keys, first, count, owner[order], place[order])

    @property
    def longest(self) -> int:
        return int((self.sizes + 3 * self.edits + 4).max())


def _candidates(points: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (item, band) rows with at least the needed hits, for one part of a text."""
    found = []
    for q, (flags, keys, first, count, owner, place) in items.tables.items():
        hashes = gram_hashes(points, q)
        at = np.flatnonzero(flags[hashes >> _FLAG_BITS])
        if len(at) == 0:
            continue
        slot = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
        hit = keys[slot] == hashes[at]
        at, slot = at[hit], slot[hit]
        counts: list[np.ndarray] = []
        for part in np.array_split(np.arange(len(at)), max(1, int(count[slot].sum()) // _HITS + 1)):
            n = count[slot[part]]
            row = np.repeat(first[slot[part]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            item = owner[row]
            width = items.edits[item] + 1
            # Shifted so that diagonals are not negative.
            diagonal = np.repeat(at[part], n) - place[row] + items.sizes[item]
            band = diagonal // width
            for b in (band, band - 1):
                counts.append(np.stack(np.unique((item << 40) | (b + 1), return_counts=True)))
        if counts:
            all_keys, inverse = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([c[1] for c in counts])).astype(np.int64)
            item, band = all_keys >> 40, (all_keys & ((1 << 40) - 1)) - 1
            enough = total >= items.needed[item]
            found.append(np.stack([item[enough], band[enough]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def banded_alignment(item: np.ndarray, texts: np.ndarray, width: int) -> np.ndarray:
    """Fewest edits of the item against windows of texts, with begin and end; one row per text.

    Texts are rows of len(item) + width characters. Column c of the band is the
    diagonal c; begin and end are free along the band.
    """
    one, offset = np.int64(1) << 32, np.arange(width + 1, dtype=np.int64)
    slope = offset * one
    # Edits in the high half, the begin in the low half: the smaller value is the better one.
    cost = np.tile(offset, (len(texts), 1))
    for j, c in enumerate(item):
        step = cost + np.where(texts[:, j : j + width + 1] == c, 0, one)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + one)
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
    end = np.argmin(cost, axis=1)
    best = cost[np.arange(len(texts)), end]
    return np.stack([best >> 32, best & (one - 1), end + len(item)], axis=1)


def matches(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, begin, end, edits): the best occurrence of every item found in each text."""
    # Texts stand in one row, too far apart for any allowed number of edits to bridge.
    gap = "\0" * (int(items.edits.max()) + 1)
    found, group, size = [], [], 0
    for number, text in enumerate(texts):
        if text:
            group.append(number)
            size += len(text)
        if group and (size >= PART or number + 1 == len(texts)):
            sizes = np.array([len(texts[g]) for g in group])
            begins = np.cumsum(sizes + len(gap)) - sizes - len(gap)
            for item, first, last, edits in _row_matches(gap.join(texts[g] for g in group), begins, items):
                own = int(np.searchsorted(begins, first, side="right")) - 1
                found.append((group[own], item, first - int(begins[own]), last - int(begins[own]), edits))
            group, size = [], 0
    return found


def _row_matches(row: str, begins: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    points, places = normalized(row)
    begins = np.searchsorted(places, begins)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    step = max(2 * PART, 2 * items.longest)
    for at in range(0, max(len(points) - items.longest, 1), step):
        part = points[at : at + step + items.longest]
        found = _candidates(part, items)
        for number in np.unique(found[:, 0]).tolist():
            item, e = items.texts[number], int(items.edits[number])
            # The band, and e diagonals on both sides for edits before and after its hits.
            low = np.unique(found[found[:, 0] == number, 1]) * (e + 1) - len(item) - e
            width = 2 * (e + 1) + 2 * e
            for some in np.array_split(low, len(low) // 256 + 1):
                index = some[:, None] + np.arange(len(item) + width + 1)
                window = np.where((index >= 0) & (index < len(part)), part[np.clip(index, 0, len(part) - 1)], 0)
                for (edits, begin, end), base in zip(banded_alignment(item, window, width).tolist(), some.tolist()):
                    first, last = max(base + begin, 0) + at, min(base + end, len(part)) + at
                    if edits <= e and last > first:
                        # Edits at either end may lie in the gap; they are no part of the text.
                        while first < last and not points[first]:
                            first += 1
                        while last > first and not points[last - 1]:
                            last -= 1
                        key = (number, int(np.searchsorted(begins, first, side="right")))
                        rank = (edits, first, last)
                        best[key] = min(best.get(key, rank), rank)
    return [(i, int(places[a]), int(places[b - 1]) + 1, e) for (i, _), (e, a, b) in sorted(best.items()) if b > a]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of bounded size."""
    known = benchmark.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = known.filter(F.char_length(F.trim("text")) > 0)
    chars = known.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for block in range(blocks):
        own = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else known
        rows = own.toArrow()
        if rows.num_rows:
            texts = [normalized(t.strip())[0] for t in rows.column("text").to_pylist()]
            pairs = [(i, t) for i, t in zip(rows.column("id").to_pylist(), texts) if len(t)]
            yield Items([i for i, _ in pairs], [t for _, t in pairs])


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows doc, item, start, stop (characters of the text), edits: the best occurrence of each item in each text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    out = spark.createDataFrame([], _MATCHES)
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for batch in small_batches(batches):
                    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                    found = [(ids[d], shared.value.ids[i], a, b, e) for d, i, a, b, e in matches(texts, shared.value)]
                    if found:
                        types = [pa.int64()] * 4 + [pa.int32()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found), types)], ["doc", "item", "start", "stop", "edits"]
                        )

        out = out.unionByName(rows.mapInArrow(run, _MATCHES))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows, whole, whose text holds no benchmark item."""
    place, schema = docs.columns.index(text_col), docs.schema
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for batch in small_batches(batches):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[m[0] for m in matches(batch.column(place).to_pylist(), shared.value)]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "start", "stop", F.col("edits").cast("bigint").alias("edits")
    )
