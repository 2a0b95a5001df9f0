r"""Near-duplicate documents: exact Jaccard links on word shingles by parity sketches.

A shingle that no other document has is part of the symmetric difference of any
pair, and a Jaccard similarity of at least s bounds that difference by
n (1 - s) / s for a set of n. So documents with more shingles of their own than
that have no link and go first. The shingles that occur more than once are kept
as flags in a bit filter of fixed size; when it fills up, fewer documents go.
Only a fixed share of the hash range is counted, twice the share a linked
document may have of its own.

Documents with equal shingle sets form classes; one of each class goes on. The
set of a class is turned into a bit sketch: every shingle flips one bit, so the
Hamming distance of two sketches is a lower bound of the symmetric difference,
which is at most t = floor(2 hi (1 - s) / (1 + s)) for linked sets of at most
``hi`` shingles. Sizes are cut into bands; the sketches of a band have t + 1 + w
blocks of 64 bits, so linked sets agree in more than w whole blocks (pigeonhole).
Blocks with less than two bits tell little: a set with at most w of them leaves
them out, and still meets each linked set in another block. A set near the upper
end of its band is entered in the next one too. Blocks are joined by a key, the
exclusive or of the hashes in the block.

Within a bucket of equal blocks no pairs are written out at first: every member
is offered with the bucket's smallest id (a star), each member takes the
smallest offer whose sketch is near enough, and the exact sets decide. Only
members of buckets that these links leave in several components are compared
with each other: few members as pairs, many in cells of bounded size. Pairs whose
sketches (folded to a few bits per block) are near enough are held against the exact
sets. So no link is lost, and a large group of near copies costs a row per copy
rather than per pair.

The exact sets are made only for documents that a bit filter of fixed size lets
pass, so texts are never shuffled.

Defined results: a null or empty text has no shingles and no link. Rows without
an id are not linked. Rows of one id are one document. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm.common import components, query, scope, stored, table
from fairlead.llm.tokens import flag_words, list_array, mix, shingle_sets, small_batches

BAND_RATIO = 1.2
#: Members of a bucket that are compared in one cell with as many others.
CELL = 512
#: Members up to which a bucket is written out as pairs; larger ones are compared in cells.
FEW = 16
#: A kept sketch has this many 64-bit words, or 8 bits for each block of a longer one. The rest is folded
#: over it by exclusive or, which only lowers distances.
FOLDED = 32
#: Bits of the filter of candidate documents.
FILTER_BITS = 1 << 23
#: Bits of the filter of shingles that occur more than once.
SHARED_BITS = 1 << 27
_U32 = np.uint64(32)
_SETS = "doc bigint, n bigint, k1 bigint, k2 bigint, sketches array<struct<band:int,keys:array<bigint>,bits:array<bigint>>>"


@lru_cache(maxsize=None)
def band_of(n: int) -> tuple[int, int]:
    """(number, largest size) of the band of a set size."""
    lo, number = 1, 0
    while True:
        hi = max(lo, int(lo * BAND_RATIO) - 1)
        if n <= hi:
            return number, hi
        lo, number = hi + 1, number + 1


def allowed_difference(total: int, percent: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add up to ``total``."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def blocks_of(hi: int, percent: int) -> tuple[int, int]:
    """(blocks, spare) of the band that ends at ``hi``: blocks = t + 1 + spare."""
    needed = allowed_difference(2 * hi, percent) + 1
    smallest = max(1, int(hi / BAND_RATIO * percent / 100))
    spare = 0
    for _ in range(50):
        fill = smallest / (needed + spare)
        weak = (needed + spare) * math.exp(-fill) * (1 + fill)
        more = math.ceil(weak + 3 * math.sqrt(weak))
        if more > needed:
            return needed, 0
        if more <= spare:
            return needed + spare, spare
        spare = more
    return needed, 0


@lru_cache(maxsize=None)
def bands_for(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, blocks, spare blocks) a set of n shingles is entered in."""
    found, size = [], n
    while size * percent <= n * 100:
        number, hi = band_of(size)
        # Where no difference is allowed only equal sets can be linked, and those form a class already.
        if allowed_difference(2 * hi, percent):
            found.append((number, *blocks_of(hi, percent)))
        size = hi + 1
    return found


def parity_sketch(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Every hash flips one of 64 bits of one block; also the exclusive or of the hashes of each block."""
    block = ((hashes >> _U32) * np.uint64(blocks)) >> _U32
    bit = (block << np.uint64(6)) | (hashes & np.uint64(63))
    parity = (np.bincount(bit.astype(np.int64), minlength=blocks * 64) & 1).astype(np.uint8)
    # Blocks follow the leading bits, so sorted hashes stand together by block.
    sums = np.zeros(blocks, np.uint64)
    if len(hashes):
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sums[block[starts].astype(np.int64)] = np.bitwise_xor.reduceat(hashes, starts)
    return np.packbits(parity).view(np.int64), sums


def folded(bits: np.ndarray) -> np.ndarray:
    """A shorter sketch with no larger distance to another one of the same length folded alike."""
    words = max(FOLDED, -(-len(bits) // 8))
    if len(bits) <= words:
        return bits
    full = np.zeros(-(-len(bits) // words) * words, np.int64)
    full[: len(bits)] = bits
    return np.bitwise_xor.reduce(full.reshape(-1, words), axis=0)


def block_keys(bits: np.ndarray, sums: np.ndarray, band: int, spare: int) -> np.ndarray:
    """Join keys of the blocks that count; all of them where too many are weak."""
    places = np.arange(len(sums), dtype=np.uint64) | np.uint64((band + 1) << 32)
    keys = mix(sums ^ mix(places)).view(np.int64)
    weak = np.bitwise_count(bits.view(np.uint64)) < 2
    return keys if np.count_nonzero(weak) > spare else keys[~weak]


def counted_share(percent: int) -> np.uint64:
    """Hashes below this are counted: twice the share of own shingles a linked set may have."""
    share = min(1.0, 2 * (100 - percent) / percent)
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def _token_counts(words: int, percent: int):
    limit = counted_share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [h[h < limit] for h in shingle_sets(batch.column(0), words)]
            if sets:
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], ["token", "times"]
                )

    return run


def _shared_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, bits = flag_words(batch.column(0).to_numpy().view(np.uint64) & np.uint64(SHARED_BITS - 1))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], ["word", "bits"])


def shared_shingles(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """Packed flags, by the low bits of the hash, of counted shingles that occur more than once."""
    counts = docs.select("text").mapInArrow(_token_counts(words, percent), "token bigint, times int")
    shared = counts.groupBy("token").agg(F.sum("times").alias("times")).filter("times > 1").select("token")
    flags = shared.mapInArrow(_shared_words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = np.zeros(SHARED_BITS // 64, np.int64)
    for part in stored(flags).toArrow().to_batches():
        packed[part.column("word").to_numpy()] = part.column("bits").to_numpy()
    return packed


def _sketcher(words: int, percent: int, shared):
    limit = counted_share(percent)

    def own(hashes: np.ndarray, flags: np.ndarray) -> int:
        """Shingles that certainly no other document has."""
        place = hashes[hashes < limit] & np.uint64(SHARED_BITS - 1)
        bit = (flags[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1
        return len(bit) - int(bit.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value.view(np.uint8)
        for batch in small_batches(batches):
            n, k1, k2, counts, bands, keys, bits = [], [], [], [], [], [], []
            for hashes in shingle_sets(batch.column(1), words):
                size = len(hashes)
                n.append(size)
                k1.append(int(np.sum(hashes).view(np.int64)))
                k2.append(int(np.sum(hashes * (hashes >> _U32 | np.uint64(1))).view(np.int64)))
                linkable = size and own(hashes, flags) * percent <= size * (100 - percent)
                entered = bands_for(size, percent) if linkable else []
                counts.append(len(entered))
                for band, blocks, spare in entered:
                    sketch, sums = parity_sketch(hashes, blocks)
                    bands.append(band)
                    bits.append(folded(sketch))
                    keys.append(block_keys(sketch, sums, band, spare))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            sketches = pa.StructArray.from_arrays(
                [pa.array(bands, pa.int32()), list_array(keys, pa.int64()), list_array(bits, pa.int64())],
                ["band", "keys", "bits"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in (n, k1, k2)),
                    pa.ListArray.from_arrays(offsets, sketches),
                ],
                ["doc", "n", "k1", "k2", "sketches"],
            )

    return run


def _filter_bits(docs: np.ndarray) -> np.ndarray:
    return mix(docs.view(np.uint64)) & np.uint64(FILTER_BITS - 1)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, bits = flag_words(_filter_bits(batch.column(0).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], ["word", "bits"])


def candidate_filter(ids: DataFrame) -> np.ndarray:
    """Flags by hash of the ids; of fixed size, and only ever lets too many pass."""
    words = ids.mapInArrow(_filter_words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = words.toArrow()
    full = np.zeros(FILTER_BITS // 64, np.int64)
    full[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return np.unpackbits(full.view(np.uint8)).astype(bool)


def _set_reader(words: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            batch = batch.filter(pa.array(wanted.value[_filter_bits(batch.column(0).to_numpy())]))
            sets = [h.view(np.int64) for h in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(sets, pa.int64())], ["doc", "shingles"])

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets are similar enough, as a stored table."""
    wanted = candidate_filter(pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    reader = _set_reader(words, docs.sparkSession.sparkContext.broadcast(wanted))
    with scope(docs.sparkSession):
        sets = stored(docs.select("doc", "text").mapInArrow(reader, "doc bigint, shingles array<bigint>"))
        both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), "a")
        both = both.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b")), "b")
        close = both.select("a", "b", "set_a", "set_b").mapInArrow(_verifier(percent), "a bigint, b bigint")
        return stored(close.distinct(), outer=True)


def _near(percent: int):
    """Hamming distance of the sketches within the allowed difference of the sizes."""
    distance = (
        "aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (s, d) -> s + d)"
    )
    return F.expr(f"{distance} <= (n_a + n_b) * {100 - percent} div {100 + percent}")


def _cell_pairs(percent: int):
    """Pairs of different components within the cells of a bucket whose sketches are near enough.

    Rows arrive ordered by cell; a cell has at most about twice CELL rows.
    """

    def of_cell(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, comp, n = (rows.column(c).to_numpy() for c in ("doc", "component", "n"))
        side, ci, cj = (rows.column(c).to_numpy() for c in ("chunk", "ci", "cj"))
        bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(doc), -1)
        left, right = np.flatnonzero(side == ci), np.flatnonzero(side == cj)
        a, b = [], []
        for i in left:
            distance = np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1, dtype=np.int64)
            close = distance <= (n[right] + n[i]) * (100 - percent) // (100 + percent)
            close &= comp[right] != comp[i]
            if ci[0] == cj[0]:
                close &= doc[right] > doc[i]
            hits = doc[right[close]]
            a.append(np.minimum(hits, doc[i]))
            b.append(np.maximum(hits, doc[i]))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            if pending:
                a, b = of_cell(pa.Table.from_batches(pending))
                pending.clear()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        last = None
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("key", "ci", "cj"))))
            begin = 0
            for i, cell in enumerate([*cells, None]):
                if i and (cell is None or cell != cells[i - 1]):
                    if last is not None and last != cells[i - 1]:
                        yield from finish()
                    pending.append(batch.slice(begin, i - begin))
                    last, begin = cells[i - 1], i
        yield from finish()

    return run


def document_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Stored rows doc, n, k1, k2 (identity of the shingle set), sketches (none without a possible link)."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_shingles(docs, words, percent))
    return stored(docs.select("doc", "text").mapInArrow(_sketcher(words, percent, shared), _SETS))


def links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified pairs (a, b) between classes; their components are those of all links."""
    classes = sets.filter("n > 0 AND doc IS NOT NULL").groupBy("n", "k1", "k2")
    classes = stored(classes.agg(F.min(F.struct("doc", "sketches")).alias("first")).select("n", "first.*"))
    entries = classes.select("doc", "n", F.explode("sketches").alias("s")).select("doc", "n", "s.band", "s.keys", "s.bits")
    blocks = entries.select("doc", "band", F.explode("keys").alias("key"))
    buckets = blocks.groupBy("key").agg(
        F.min("doc").alias("center"), F.max("doc").alias("other"), F.count("*").alias("members")
    )
    buckets = stored(buckets.filter("center < other"))
    # Two members need no second look at the blocks.
    star = (
        buckets.filter("members = 2")
        .select(F.col("center").alias("a"), F.col("other").alias("b"))
        .unionByName(
            blocks.join(buckets.filter("members > 2").select("key", "center"), "key")
            .filter("doc <> center")
            .select(F.col("center").alias("a"), F.col("doc").alias("b"))
        )
        .distinct()
    )
    left = entries.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), "band", F.col("bits").alias("bits_a"))
    right = entries.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), "band", F.col("bits").alias("bits_b"))

    def with_sketches(pairs: DataFrame) -> DataFrame:
        return pairs.join(left, "a").join(right, ["b", "band"])

    offers = with_sketches(star).filter(_near(percent))
    first = stored(offers.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = verified(docs, first, words, percent)

    groups = components(found).withColumnRenamed("node", "doc")
    placed = classes.select("doc").join(groups, "doc", "left")
    placed = stored(placed.select("doc", F.coalesce("component", "doc").alias("component")))
    # Buckets whose members these links have not joined.
    located = blocks.join(buckets.select("key", "members"), "key").join(placed, "doc")
    open_buckets = located.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")
    )
    open_buckets = stored(open_buckets.filter("lo < hi").select("key", "members"))
    members = blocks.join(open_buckets, "key").join(placed, "doc")
    few = members.filter(F.col("members") <= FEW).groupBy("key").agg(
        F.collect_set(F.struct("doc", "component")).alias("all")
    )
    few = few.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    few = few.filter("x.doc < y.doc AND x.component <> y.component")
    few = few.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()

    chunks = F.ceil(F.col("members") / CELL).cast("int")
    sketches = entries.select("doc", "n", "band", "bits")
    many = members.filter(F.col("members") > FEW).withColumn("chunks", chunks).join(sketches, ["doc", "band"])
    many = many.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = many.select(
        "key", F.least("chunk", "with").alias("ci"), F.greatest("chunk", "with").alias("cj"),
        "chunk", "doc", "component", "n", "bits",
    )
    cells = cells.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj")
    many = cells.mapInArrow(_cell_pairs(percent), "a bigint, b bigint")
    rest = with_sketches(few.unionByName(many).distinct()).filter(_near(percent)).select("a", "b").distinct()
    return stored(found.unionByName(verified(docs, stored(rest), words, percent)), outer=True)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc, n_shingles, component (smallest id reachable by links)."""
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    sets = document_sets(base, words, percent)
    with scope(docs.sparkSession):
        joined = links(base.filter("doc IS NOT NULL"), sets, words, percent)
    # Members of a class hang on its smallest id.
    firsts = sets.filter("n > 0 AND doc IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("doc").alias("first"))
    keys = stored(sets.select("doc", "n", "k1", "k2").join(firsts, ["n", "k1", "k2"], "left"))
    # Rows of one id are one document, whatever texts they carry.
    repeated = keys.groupBy("doc").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a < b")
    several = keys.join(repeated.select("doc"), "doc", "left_semi")
    several = several.filter("first IS NOT NULL AND first <> doc").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    of_class = components(joined.unionByName(several)).withColumnRenamed("node", "first")
    found = keys.join(of_class, "first", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "first", "doc"))
    return found.select("doc", F.col("n").alias("n_shingles"), component.alias("component"))


def distinct_documents(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Input rows but for documents that a smaller id of their component stands for."""
    gone = near_duplicates(docs, words, percent, id_col, text_col).filter("component < doc").select("doc").distinct()
    return docs.join(gone, docs[id_col] == gone["doc"], "left_anti").select(*docs.columns)


@query(
    "op9_ngram_jaccard_join",
    r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1),
             lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
    FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
         AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
    SELECT a AS node, b AS other FROM links
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles,
       least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON s.doc_id = r.node
GROUP BY s.doc_id, s.shingles
""",
)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
