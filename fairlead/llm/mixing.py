r"""Mixing of sources to target weights, by hash thresholds found in histograms.

Sources weigh 1, 2, 3, 1, 2, ... in order of their name (null last), or as given,
and share a budget of words (by default all words there are). A source gives at
most MAX_REPEATS times its own words; what its share has beyond that is shared
again by weight among the others until no share is above its limit (``targets``).

A source whose target is k whole times its size and a rest takes every document
k times, and once more the documents whose hash lies below a threshold. The
threshold is found without sorting the documents: words are summed by source and
leading bits of the hash, the running sum shows the bucket in which the rest ends,
and only that bucket is divided again by the next bits, until it has at most LIST
rows or is a single hash. Sums are combined before they are shuffled, a source has
at most 2 ** MOST_BITS buckets at a time whatever its size, and the bits of a step
follow from the rows left, so the last bucket has some hundred documents. Of
these few, in order of the hash, every one that still fits is taken, and single
documents are exchanged as long as that comes nearer, which brings the source within
some words of its target unless it has very few documents; they are listed by hash beside the
threshold. The documents themselves are only filtered.

Defined results: words are runs of bytes that are no white space
[\x20\x09-\x0D]; null and empty texts have none and are taken with 0 words. A row
is drawn by the hash of its id and text, so repeated rows are drawn together, and
the result depends neither on the order of the rows nor on their partitions. Null
is a source of its own. An empty table gives an empty mix. Other columns are kept
by ``mix`` and not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, scope, stored, table
from fairlead.operators.numbering import numbered

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 12
#: Bits of a hash; of these the leading ones number the buckets.
BITS = 63
MOST_BITS = 9
#: Rows of the last bucket, which is gone through one by one.
LIST = 1024
#: A source's own row is met by its documents under so many keys, where it has to be shuffled.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def measured(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, and ``_source``, ``_words``, ``_hash`` (0 to 2 ** 63 - 1) and ``_salt``."""
    text = F.col(f"`{text_col}`")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`"), text), 1)
    out = docs.withColumns({"_source": F.col(f"`{source_col}`"), "_words": n_words(text), "_hash": drawn})
    return out.withColumn("_salt", F.col("_hash") % SALTS)


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """Add ``target`` to rows of words and weight, one per source.

    A share is weight * level, cut at its limit; the level rises as long as a
    source is cut. Each round is one row of sums over the sources.
    """
    limit, weight = F.lit(max_repeats) * F.col("words"), F.col("weight").cast("double")
    total = sources.agg(F.sum("words")).first()[0] or 0
    budget = total if budget is None else min(budget, max_repeats * total)
    level = 0.0
    while True:
        cut = limit <= weight * level
        fixed, open_weight = sources.agg(F.sum(F.when(cut, limit)), F.sum(F.when(~cut, weight))).first()
        if not open_weight or (budget - (fixed or 0)) / open_weight <= level:
            break
        level = (budget - (fixed or 0)) / open_weight
    return sources.withColumn("target", F.least(limit.cast("double"), weight * level))


def _salted(small: DataFrame) -> DataFrame:
    """Rows of sources under every salt, so that a large source is no single join key."""
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def _inside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of each source that lie in its open bucket: number, _hash, _words and the state's columns."""
    joined = rows.join(_salted(state), ["number", "_salt"])
    return joined.filter("shiftright(_hash, shift) = prefix")


#: The bucket in which the budget ends, from the sorted buckets of a source.
_END = """
aggregate(buckets, named_struct('taken', taken, 'hit', cast(null as struct<prefix: bigint, words: bigint, n: bigint>)),
    (s, b) -> if(s.hit is null and s.taken + b.words <= budget,
        named_struct('taken', s.taken + b.words, 'hit', s.hit), named_struct('taken', s.taken, 'hit', coalesce(s.hit, b))))
"""
_STATE = ("number", "budget", "prefix", "shift", "taken", "n")


def _boundaries(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Narrow each source's bucket, in which its budget ends, until it is small."""
    closed = None
    while True:
        is_small = (F.col("n") <= LIST) | (F.col("shift") == 0)
        small, open_ = state.filter(is_small), state.filter(~is_small)
        closed = small if closed is None else closed.unionByName(small)
        if open_.isEmpty():
            return closed
        bits = F.least(F.lit(MOST_BITS), F.col("shift"), F.ceil(F.log2(F.col("n") / (LIST // 2))).cast("int"))
        open_ = open_.withColumn("next", F.col("shift") - bits)
        sums = _inside(rows, open_).groupBy("number", F.expr("shiftright(_hash, next)").alias("prefix"))
        sums = sums.agg(F.sum("_words").alias("words"), F.count(F.lit(1)).alias("n"))
        listed = sums.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("prefix", "words", "n"))).alias("buckets"))
        found = listed.join(open_.select("number", "budget", "taken", "next"), "number").withColumn("end", F.expr(_END))
        state = stored(
            found.select(
                "number", "budget", F.col("end.hit.prefix").alias("prefix"), F.col("next").alias("shift"),
                F.col("end.taken").alias("taken"), F.col("end.hit.n").alias("n"),
            )
        )


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a source's last bucket, by hash, every hash whose words still fit; then the one exchange that comes nearest."""
    rows = rows.sort_values("_hash")
    keys, words = rows["_hash"].to_numpy(), rows["words"].to_numpy()
    rest = int(rows["budget"].iat[0] - rows["taken"].iat[0])
    chosen = np.zeros(len(rows), bool)
    for i, n in enumerate(words.tolist()):
        if n <= rest:
            chosen[i], rest = True, rest - n
    # One more in, one out, or both, as long as that comes nearer; place -1 stands for none.
    size = np.append(words, 0)
    while rest:
        goes, comes = (np.concatenate(([-1], np.flatnonzero(mask))) for mask in (chosen, ~chosen))
        comes = comes[np.argsort(size[comes], kind="stable")]
        at = np.searchsorted(size[comes], size[goes] + rest)
        near = np.stack([comes[np.maximum(at - 1, 0)], comes[np.minimum(at, len(comes) - 1)]])
        left = rest - size[near] + size[goes]
        best = np.unravel_index(np.argmin(np.abs(left)), left.shape)
        if abs(left[best]) >= abs(rest):
            break
        rest = int(left[best])
        for place, now in ((goes[best[1]], False), (near[best], True)):
            if place >= 0:
                chosen[place] = now
    return pd.DataFrame({"number": [int(rows["number"].iat[0])], "chosen": [keys[chosen].tolist()]})


def plan(
    rows: DataFrame,
    weights: tuple[float, ...] | dict[str | None, float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    budget: int | None = None,
) -> DataFrame:
    """How each source is drawn, from ``measured`` rows.

    One row per source: source, words, weight, target, copies (of every
    document), threshold and chosen (hashes taken once more: those below the
    threshold and the listed ones). ``weights`` is a cycle over the sorted
    sources or a weight per source (0 where it is not named).
    """
    narrow = rows.select("_source", "_words", "_hash", "_salt")
    with scope(rows.sparkSession):
        sizes = narrow.groupBy("_source").agg(F.sum("_words").alias("words"), F.count(F.lit(1)).alias("n"))
        order = [F.col("source").asc_nulls_last()]
        sources = numbered(stored(sizes.withColumnRenamed("_source", "source")), order, store=stored)
        if isinstance(weights, dict):
            pairs = [(name, float(w)) for name, w in weights.items()]
            named = rows.sparkSession.createDataFrame(pairs, "name string, weight double")
            sources = sources.join(named, sources["source"].eqNullSafe(named["name"]), "left").drop("name")
            sources = sources.fillna(0.0, ["weight"])
        else:
            cycle = F.array(*[F.lit(float(w)) for w in weights])
            sources = sources.withColumn("weight", F.get(cycle, (F.col("number") % len(weights)).cast("int")))
        shared = stored(targets(stored(sources), max_repeats, budget))
        whole = F.round("target").cast("bigint")
        shared = shared.withColumns(
            {
                "copies": F.when(F.col("words") > 0, F.expr("cast(round(target) as bigint) div nullif(words, 0)")).otherwise(0),
                "budget": F.when(F.col("words") > 0, whole % F.expr("nullif(words, 0)")).otherwise(0),
            }
        )
        start = shared.filter("budget > 0").select(
            "number", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(BITS).alias("shift"),
            F.lit(0).cast("bigint").alias("taken"), "n",
        )
        known = _salted(shared.select("number", "source"))
        own = narrow["_source"].eqNullSafe(known["source"]) & (narrow["_salt"] == known["_salt"])
        drawn = stored(narrow.join(known, own).select("number", "_hash", "_words", narrow["_salt"]))
        ends = stored(_boundaries(drawn, stored(start)))
        last = _inside(drawn, ends).groupBy("number", "_hash", "budget", "taken").agg(F.sum("_words").alias("words"))
        chosen = last.groupBy("number").applyInPandas(_fill, "number bigint, chosen array<bigint>")
        bounds = ends.select("number", F.expr("shiftleft(prefix, shift)").alias("threshold")).join(chosen, "number", "left")
        out = shared.join(bounds, "number", "left").select(
            "source", "words", "weight", "target", "copies",
            F.coalesce("threshold", F.lit(0)).alias("threshold"),
            F.coalesce("chosen", F.array().cast("array<bigint>")).alias("chosen"),
        )
        return stored(out, outer=True)


def drawn(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``measured`` rows with _copies (how often the mix takes the document), _source_words and _target."""
    # Of one name space with the rows, whatever those are called.
    small = _salted(sources.select(F.struct("*").alias("_plan"))).withColumnRenamed("_salt", "_plan_salt")
    joined = rows.join(small, F.col("_source").eqNullSafe(F.col("_plan.source")) & (F.col("_salt") == F.col("_plan_salt")))
    again = (F.col("_hash") < F.col("_plan.threshold")) | F.array_contains("_plan.chosen", F.col("_hash"))
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (F.col("_plan.copies") + again.cast("bigint")).alias("_copies"),
        F.col("_plan.words").alias("_source_words"),
        F.col("_plan.target").alias("_target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, budget: int | None = None, **columns: str) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it is taken."""
    rows = measured(docs, **columns)
    taken = drawn(rows, plan(rows, weights, max_repeats, budget)).filter("_copies > 0")
    repeated = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op12_source_mixing")
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # Texts are read once; what is drawn from is an id, a source, a hash and a count.
    rows = stored(measured(docs).drop("text"))
    return drawn(rows, plan(rows)).select(
        "doc_id",
        F.col("_words").alias("size"),
        F.col("_source_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_words")).alias("taken"),
    )
