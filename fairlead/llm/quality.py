r"""Text quality from random-indexing word vectors and a small calibrated network.

Word vectors: every word has an index vector, a few signed ones at places its
hash names. The vector of a word is the sum of the index vectors of the words up
to ``window`` places away, over the whole corpus. Every word that makes up at
least ``share`` of all words has a vector of its own; there can be no more than
``1 / share`` such words, so the table may be sent to all tasks at every size of
the corpus, and which words have one does not drift with it. Rarer words, each
below that share, are put together in ``BUCKETS`` rows by hash. Words are counted
exactly, in one shuffle of distinct words; each task sums its texts into one
table, and tables are summed per row after one more shuffle. A document is the
mean of the vectors of its words, beside the mean index vector of its marks:
which kinds of characters a word has, and whether it repeats the word before.

The network (one hidden layer) is trained on at most ``max_rows`` labelled
documents, those with the smallest hash of their id. A fifth of them is held
back for the temperature that calibrates the probabilities. Vectors are summed
over all documents; only the network is fitted on the sample.

Defined results: null and empty texts have a zero vector and get the score the
network gives it. Documents without an id are scored too, as no score depends on
ids, language, source or labels. Labels that are null are no labels; a document
labelled twice counts with its smaller label. Without both labels in the sample
every score is the share of good ones (0.5 without any). Repeated rows get equal
scores, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, scope, stored, table
from fairlead.llm.tokens import mix, small_batches, words_of

#: Rows that the words below ``SHARE`` have in common.
BUCKETS = 1 << 13
#: Words with at least this part of all words have a vector of their own.
SHARE = 1e-5
#: Neighbours on each side that make up the context of a word.
WINDOW = 1
DIMS = 64
#: Signed ones in an index vector.
_ONES = 4
_STEP = 1 << 17
#: Words after which a task hands over its counts, so that they stay small numbers.
_FLUSH = 1 << 28
_REPEAT = np.uint64(0x5EED)
MAX_ROWS = 20_000
HIDDEN = 32
THRESHOLD = 0.3


def _index_places(hashes: np.ndarray):
    """(places, signs) of the ones in the index vectors of hashed words, one pair per one."""
    for j in range(_ONES):
        part = hashes >> np.uint64(16 * j)
        yield (part & np.uint64(DIMS - 1)).astype(np.int64), 1 - 2 * ((part >> np.uint64(6)) & np.uint64(1)).astype(np.int32)


def _row_of(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row of each hashed word: its place in the sorted ``words``, or one of the shared rows behind them."""
    rows = len(words) + (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        rows = np.where(words[at] == hashes, at, rows)
    return rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashed words with counts, over some million words at a time."""

    def counts(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, n = np.unique(np.concatenate(parts), return_counts=True)
        for at in range(0, len(words), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(words[part].view(np.int64)), pa.array(n[part])], ["word", "n"])

    parts, size = [], 0
    for batch in small_batches(batches):
        parts.append(words_of(batch.column(0), with_shapes=False)[0])
        size += len(parts[-1])
        if size >= 1 << 21:
            yield from counts(parts)
            parts, size = [], 0
    if size:
        yield from counts(parts)


def frequent_words(texts: DataFrame, share: float = SHARE) -> np.ndarray:
    """Sorted hashes of the words with at least ``share`` of all words: at most ``1 / share``."""
    with scope(texts.sparkSession):
        counts = texts.mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        counts = stored(counts)
        total = counts.agg(F.sum("n")).first()[0] or 0
        found = counts.filter(F.col("n") >= F.lit(share * total)).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().view(np.uint64))


def _context_sums(words: Broadcast, window: int):
    """One row per row of the table with the summed index vectors of the neighbours of its words."""

    def rows_of(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        table_of = sums.reshape(-1, DIMS)
        used = np.flatnonzero(table_of.any(axis=1))
        for at in range(0, len(used), 1 << 13):
            rows = used[at : at + (1 << 13)]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(table_of[rows].ravel()), DIMS)
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), flat.cast(pa.list_(pa.int32()))], ["bucket", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words.value
        sums, seen = np.zeros((len(own) + BUCKETS) * DIMS, np.int32), 0
        for batch in small_batches(batches):
            hashes, _, begins = words_of(batch.column(0), with_shapes=False)
            owner = np.repeat(np.arange(len(begins) - 1, dtype=np.int32), np.diff(begins))
            for at in range(0, len(hashes), _STEP):
                # The step's words and those after it that are still neighbours.
                near, text = hashes[at : at + _STEP + window], owner[at : at + _STEP + window]
                start = _row_of(near, own) * DIMS
                places = list(_index_places(near))
                for d in range(1, window + 1):
                    left = np.flatnonzero(text[:-d] == text[d:])
                    left = left[left < _STEP]
                    right = left + d
                    for place, sign in places:
                        np.add.at(sums, start[left] + place[right], sign[right])
                        np.add.at(sums, start[right] + place[left], sign[left])
            seen += len(hashes)
            if seen >= _FLUSH:
                yield from rows_of(sums)
                sums[:], seen = 0, 0
        yield from rows_of(sums)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each row in this partition: at most one row for each of the table's."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("vector").flatten().to_numpy().reshape(-1, DIMS)
        buckets, place = np.unique(batch.column("bucket").to_numpy(), return_inverse=True)
        part = np.zeros((len(buckets), DIMS), np.int64)
        np.add.at(part, place, vectors)
        for bucket, vector in zip(buckets.tolist(), part):
            sums[bucket] = sums[bucket] + vector if bucket in sums else vector
    if sums:
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(list(sums.values()))), DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), flat.cast(pa.list_(pa.int64()))], ["bucket", "vector"])


@dataclass(frozen=True)
class Vectors:
    """Unit vectors: a row for each of the sorted hashed ``words``, then the shared rows."""

    words: np.ndarray
    rows: np.ndarray

    def row_of(self, hashes: np.ndarray) -> np.ndarray:
        return _row_of(hashes, self.words)


def word_vectors(docs: DataFrame, text_col: str = "text", window: int = WINDOW, share: float = SHARE) -> Vectors:
    """Vectors summed over all documents; the table has at most 1 / share + BUCKETS rows."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    words = frequent_words(texts, share)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    parts = texts.mapInArrow(_context_sums(shared, window), "bucket int, vector array<int>")
    total = parts.repartition("bucket").mapInArrow(_add_up, "bucket int, vector array<bigint>").toArrow()
    vectors = np.zeros((len(words) + BUCKETS, DIMS), np.float32)
    if total.num_rows:
        found = total.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, DIMS).astype(np.float64)
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        vectors[total.column("bucket").to_numpy()] = found / np.where(norms > 0, norms, 1)
    return Vectors(words, vectors)


def document_vectors(column: pa.Array, vectors: Vectors) -> np.ndarray:
    """Pooled word vectors, pooled marks and the logarithm of the length, per text."""
    hashes, shapes, begins = words_of(column, with_shapes=True)
    texts = len(begins) - 1
    counts = np.diff(begins)
    owner = np.repeat(np.arange(texts), counts)
    pooled = np.zeros((texts, DIMS))
    rows = vectors.row_of(hashes)
    for at in range(0, len(rows), _STEP):
        mine = owner[at : at + _STEP]
        starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        pooled[mine[starts]] += np.add.reduceat(vectors.rows[rows[at : at + _STEP]], starts, axis=0)
    marks = np.zeros(texts * DIMS)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    for who, what in ((owner, mix(shapes + np.uint64(1))), (owner[same], mix(np.full(int(same.sum()), _REPEAT)))):
        for place, sign in _index_places(what):
            marks += np.bincount(who * DIMS + place, sign, texts * DIMS)
    size = np.maximum(counts, 1)[:, None]
    return np.hstack([pooled / size, marks.reshape(texts, DIMS) / size, np.log1p(counts)[:, None]])


@dataclass(frozen=True)
class Model:
    vectors: Vectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum((features - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return _sigmoid(self.logits(document_vectors(column, self.vectors)) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _train(x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 7):
    """Adam on the cross-entropy with mild weight decay; rows come in a fixed order."""
    rng = np.random.default_rng(seed)
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, shapes[0]), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(())]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            hidden = np.maximum(x[rows] @ w[0] + w[1], 0)
            error = (_sigmoid(hidden @ w[2] + w[3]) - y[rows]) / len(rows)
            back = np.outer(error, w[2]) * (hidden > 0)
            grads = [x[rows].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], error.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.002 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the smallest cross-entropy on held-back rows."""
    tried = np.geomspace(0.25, 8, 81)
    p = np.clip(_sigmoid(logits[None, :] / tried[:, None]), 1e-9, 1 - 1e-9)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(axis=1)
    return float(tried[int(np.argmin(loss))])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` of the labels outside fold 0, those with the smallest hash of the id: id, y, fold.

    A cut-off on the hash follows from the number of labels, so that all tasks
    together hand over little more than the sample. Should too few rows lie
    under it, which is next to impossible, all are ranked.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.min("quality").alias("y"))
    n, wanted = known.count(), max_rows + 10 * max_rows**0.5 + 100
    if n > wanted:
        under = known.filter(F.xxhash64("id") < F.lit(int(wanted / n * 2**64) - 2**63))
        if under.count() >= max_rows:
            known = under
    return known.orderBy(F.xxhash64("id"), "id").limit(max_rows).withColumn("fold", fold(F.col("id")))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_ROWS,
    epochs: int = 40,
    window: int = WINDOW,
    share: float = SHARE,
) -> Model:
    spark = docs.sparkSession
    vectors = word_vectors(docs, window=window, share=share)
    table_of_vectors = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = document_vectors(batch.column("text"), table_of_vectors.value)
            columns = [batch.column(c) for c in ("id", "y", "fold")]
            columns.append(pa.array(found.tolist(), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "fold", "x"])

    # The sample has at most max_rows rows of three numbers, so it may be sent to all tasks.
    sample = F.broadcast(labelled_sample(labels, max_rows))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(sample, "id")
    rows = texts.select("id", "y", "fold", "text").mapInArrow(features, "id bigint, y int, fold bigint, x array<double>")
    got = rows.toArrow().sort_by("id")
    zero = np.zeros(2 * DIMS + 1)
    y = got.column("y").to_numpy().astype(float)
    if len(y) < 10 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(vectors, zero, zero + 1, np.zeros((len(zero), HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0, share)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    held = got.column("fold").to_numpy() == 1
    if held.all() or not held.any():
        held = np.arange(len(y)) % 5 == 1
    mean, scale = x[~held].mean(0), x[~held].std(0) + 1e-6
    w = _train((x[~held] - mean) / scale, y[~held], epochs)
    model = Model(vectors, mean, scale, w[0], w[1], w[2], float(w[3]), 1.0)
    return Model(vectors, mean, scale, w[0], w[1], w[2], float(w[3]), _temperature(model.logits(x[held]), y[held]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, score for every input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id bigint, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The input rows, whole, whose text scores at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        (fold(F.col("id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
