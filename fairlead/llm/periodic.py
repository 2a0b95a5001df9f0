r"""Periodic runs of words: stretches that repeat a block of words at least three times.

A run is a stretch of consecutive words (runs of bytes that are no white space
[\x20\x09-\x0D]) with smallest period q, at least max(MIN_WORDS, 3 * q) long, that
no neighbouring word extends with the same period. The smallest period is meant,
so a run of period 2 is not reported as one of period 4 as well.

Words are read from left to right, and the diagonals (lags) on which a word equals
an earlier one carry the length of their match. A diagonal emits its run when the
match ends and is long enough. Two facts keep this sparse without losing a run:

* A diagonal of lag q has to match at least max(MIN_WORDS - q, 2 * q) words, so it
  can be entered when the last g words match those at the lag, with g = 16 for
  q < 16, and g = 32, 64, ... for q from g / 2 to g - 1. Instead of the earlier
  occurrences of a word, those of the g words that begin at it are looked up.
* Of these only the nearest can be a smallest period: if the same g words begin
  three times within g words, the distances are multiples of one period (two
  overlapping occurrences give the words that period), and a longer lag in a
  period's multiple is not the smallest. So one lag per word and g is active, and
  a diagonal ends where the nearest occurrence changes.

Equal groups of g words get equal numbers by doubling: numbers of two halves make
the number of the whole. Positions whose words occur nowhere else leave, so
ordinary text is done after a few doublings; the work is n log n for any text.

Defined results: null and empty texts have no words and no runs. Rows are worked
on alone, so repeated rows get equal results, and rows without an id too. Other
columns of the input are not looked at. Texts are taken whole; several of them
share one pass over about BATCH_WORDS words, a longer text has a pass of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, table

MIN_WORDS = 24
_FIRST = 16
BATCH_WORDS = 1 << 18


def _numbers(words: pa.Array) -> np.ndarray:
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _renumber(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key among the distinct ones, and how often it occurs."""
    if not len(keys):
        return keys, keys
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=keys[order[0]]) != 0
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new)
    return number, np.bincount(number)[number]


def _nearest(at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Distance to the position before with the same number, 0 if there is none; ``at`` ascends."""
    order = np.argsort(number, kind="stable")
    lag = np.zeros(len(at), np.int64)
    again = number[order][1:] == number[order][:-1]
    lag[order[1:][again]] = (at[order][1:] - at[order][:-1])[again]
    return lag


def runs_of(number: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period), by start and period, of a sequence of word numbers from 0 on."""
    n, found = len(number), []
    # at: positions whose next g words occur elsewhere too; name: their number, by position.
    at, g = np.arange(n), 1
    name = np.full(n, -1, np.int64)
    at = at[np.bincount(number, minlength=1)[number] > 1] if n else at
    name[at] = number[at]
    while len(at):
        if g >= _FIRST:
            lag = _nearest(at, name[at])
            low = 1 if g == _FIRST else g // 2
            active = (lag >= low) & (lag < g)
            here, lag = at[active], lag[active]
            # A diagonal goes on while the next word has the same lag.
            ends = np.flatnonzero(np.append((np.diff(here) != 1) | (np.diff(lag) != 0), True)) if len(here) else []
            first = 0
            for end in ends:
                period = int(lag[end])
                matched = int(here[end] - here[first]) + g
                if matched + period >= max(min_words, 3 * period):
                    found.append((int(here[first]) - period, matched + period, period))
                first = end + 1
        pairs = at[at + g < n]
        pairs = pairs[name[pairs + g] >= 0]
        if not len(pairs):
            break
        own, times = _renumber(name[pairs] * (n + 1) + name[pairs + g])
        name[at] = -1
        at = pairs[times > 1]
        name[at] = own[times > 1]
        g *= 2
    return np.array(sorted(set(found), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of as many rows as make about BATCH_WORDS words."""
    for batch in batches:
        ids, texts, n = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            # bytes.split() cuts at exactly the six bytes of white space that are meant.
            words = text.as_py().encode().split() if text.is_valid else []
            ids.append(doc)
            texts.append(words)
            n += len(words) + 1
            if n >= BATCH_WORDS:
                yield ids, texts
                ids, texts, n = [], [], 0
        if ids:
            yield ids, texts


def _runs_by_text(texts: list[list[bytes]], min_words: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, starts counted inside it."""
    sizes = np.array([len(words) + 1 for words in texts])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    total = int(sizes.sum())
    number = np.empty(total, np.int64)
    # A number of its own between two texts, which nothing can match across.
    is_word = np.ones(total, bool)
    is_word[begin + sizes - 1] = False
    number[is_word] = _numbers(pa.array([w for words in texts for w in words], pa.binary()))
    number[~is_word] = number[is_word].max(initial=-1) + 1 + np.arange(len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(number, min_words).tolist():
        k = int(np.searchsorted(begin, start, "right")) - 1
        out[k].append((start - int(begin[k]), length, period))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs repeat after their first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text: doc_id, start, length, period."""

    def work(batches):
        for ids, texts in _parts(batches):
            rows = [(i, *run) for i, runs in zip(ids, _runs_by_text(texts, min_words)) for run in runs]
            columns = list(zip(*rows)) or [[]] * 4
            names = ["doc_id", "start", "length", "period"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return _narrow(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, start bigint, length bigint, period bigint")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def collapse(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period) and text with one period of each run, joined by single spaces."""

    def work(batches):
        for ids, texts in _parts(batches):
            found = _runs_by_text(texts, min_words)
            runs = [[dict(zip(("start", "length", "period"), run)) for run in own] for own in found]
            kept = [b" ".join(_kept(words, own)).decode() for words, own in zip(texts, found)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [pa.array(ids, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "text"])

    schema = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"
    return _narrow(docs, id_col, text_col).mapInArrow(work, schema)


_NAMED = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents (by hash of the id) goes periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", h.alias("h"))
    some = some.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(_NAMED)))
    some = some.select("doc_id", "text", "words", F.expr("h div 10").alias("g"), F.size("words").alias("n"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.expr("g % nullif(n, 0)")))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr(
        "array_join(transform(words, (w, i) -> if(i >= a, get(words, cast(a + (i - a) % p as int)), w)), ' ')"
    )
    return some.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


#: Exact comparison of length / period; runs come by start and period, so the first of equals stays.
_LARGEST = """
aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
    (best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))
"""


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = collapse(docs).withColumn("best", F.expr(_LARGEST))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return done.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
