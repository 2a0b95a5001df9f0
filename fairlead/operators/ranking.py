"""Exact ranks, percentiles and quantiles without a global sort in one task."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fairlead.session import cut_lineage

#: Steps a bracket of a quantile is cut into; a bracket is a fixed share of the rows.
STEPS = 512
ROWS_PER_TASK = 1_000_000


def cumulative_counts(counts: DataFrame, keys: list[str], value: str, bucket: str) -> DataFrame:
    """Add ``rank``, the sum of ``n`` over all values up to this one within ``keys``, and ``size``, over all.

    ``counts`` has one row per (keys, value) with its frequency ``n``; ``bucket``
    is any non-decreasing function of the value. Each (keys, bucket) is summed
    by itself and the totals of the buckets before it are added. The totals
    have one row per bucket, so buckets must be far fewer than values.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(value)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy(*keys, bucket)
        .agg(F.sum("n").alias("_n"))
        .select(
            *keys,
            bucket,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("size"),
        )
    )
    return (
        counts.withColumn("_inside", F.sum("n").over(inside))
        .join(totals, [*keys, bucket])
        .withColumn("rank", F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before")
    )


def usable_scores(df: DataFrame, column: str) -> DataFrame:
    """Scores that can take part in a reference: present and finite."""
    score = F.col(column).cast("double")
    finite = ~F.isnan(score) & (F.abs(score) < float("inf"))
    return df.select(score.alias("score")).filter(score.isNotNull() & finite)


def _ranged(counts: DataFrame, rows_per_range: int) -> DataFrame:
    """Distinct scores with ``bucket``, ranges of about ``rows_per_range`` of them each."""
    ranges = max(2, -(-counts.count() // rows_per_range))
    inner = counts.approxQuantile("score", [i / ranges for i in range(1, ranges)], 0.5 / ranges) or [0.0]
    splits = [float("-inf"), *sorted(set(inner) - {float("-inf"), float("inf")} or {0.0}), float("inf")]
    return Bucketizer(splits=splits, inputCol="score", outputCol="bucket", handleInvalid="keep").transform(counts)


@dataclass(frozen=True)
class ScoreReference:
    """Distribution of reference scores: frequency ``n`` of every distinct score, ``total`` in all."""

    counts: DataFrame
    total: int

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        head = json.dumps({"total": self.total})
        spark = self.counts.sparkSession
        spark.createDataFrame([(head,)], "head string").write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ScoreReference":
        head = json.loads(spark.read.parquet(f"{path}/head").first().head)
        return cls(spark.read.parquet(f"{path}/counts").select("score", "n"), head["total"])


def fit_reference(df: DataFrame, column: str = "ml_anomaly_score") -> ScoreReference:
    """Learn the distribution of the finite scores; none at all is an error.

    The input is read once, into a stored table of distinct scores.
    """
    if column not in df.columns:
        raise ValueError(f"Reference data must contain {column}.")
    counts = cut_lineage(usable_scores(df, column).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("No valid reference scores to calibrate with.")
    return ScoreReference(counts, total)


def with_percentile(
    df: DataFrame,
    reference: ScoreReference,
    column: str = "ml_anomaly_score",
    name: str = "ml_anomaly_percentile",
    spread: str = "id",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """100 x share of reference scores at or below each score; NULL stays NULL.

    Distinct scores of both sides are ranked together, in ranges of about
    ``rows_per_task`` scores, and joined back. The ranges follow reference and
    asked scores alike, so scores that lie outside the reference are spread too. A score shared by very many rows (and the missing score) is split over
    several join keys, so no task receives more than about ``rows_per_task`` rows.
    """
    score = F.col(column).cast("double")
    score = F.when(~F.isnan(score), score)
    probes = df.select(score.alias("score")).filter("score is not null")
    probes = probes.groupBy("score").agg(F.count(F.lit(1)).alias("_rows"))
    none = F.lit(0).cast("bigint")
    both = reference.counts.select("score", "n", none.alias("_rows")).unionByName(
        probes.select("score", none.alias("n"), "_rows")
    )
    both = cut_lineage(both.groupBy("score").agg(F.sum("n").alias("n"), F.sum("_rows").alias("_rows")))
    ranked = (
        cumulative_counts(_ranged(both, rows_per_task), [], "score", "bucket")
        .filter("_rows > 0")
        .select(
            F.col("score").alias("_score"),
            (F.col("rank") * 100.0 / F.lit(reference.total)).alias(name),
            F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_parts"),
        )
    )
    # At most one hot score per ``rows_per_task`` rows: sent to all tasks, so that the rows are shuffled once only.
    hot = F.broadcast(ranked.filter("_parts > 1").select("_score", "_parts"))
    table = ranked.select("_score", name, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    row_hash = F.xxhash64(F.col(spread))
    keyed = (
        df.withColumn("_score", score)
        .join(hot, "_score", "left")
        .withColumn(
            "_part",
            F.when(F.col("_score").isNull(), -1 - F.pmod(row_hash, F.lit(1 << 20)))
            .otherwise(F.pmod(row_hash, F.coalesce("_parts", F.lit(1))))
            .cast("int"),
        )
        .drop("_parts")
    )
    return keyed.join(table, ["_score", "_part"], "left").drop("_score", "_part")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of several columns.

    First a sketch brackets every wanted order statistic, then one pass counts
    what lies below each bracket and only values inside a bracket are ranked.
    What reaches the driver is a few numbers per quantile.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    numbers = df.select([v.alias(c) for c, v in values.items()])
    sizes = numbers.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    error = 0.001
    wanted = []  # (column index, probability index, bracket)
    probes = sorted({min(1.0, max(0.0, p + side * 2 * error)) for p in probabilities for side in (-1, 1)})
    sketched = numbers.approxQuantile(columns, probes, error)
    for i, column in enumerate(columns):
        size = sizes[f"n{i}"]
        if not size:
            continue
        at = dict(zip(probes, sketched[i]))
        for j, p in enumerate(probabilities):
            low = at[min(1.0, max(0.0, p - 2 * error))]
            high = at[min(1.0, max(0.0, p + 2 * error))]
            if size * error < 4:  # too few rows for the sketch's rank bound to matter
                low, high = sizes[f"lo{i}"], sizes[f"hi{i}"]
            wanted.append((i, j, low, high))
    if not wanted:
        return {c: [None] * len(probabilities) for c in columns}
    below = numbers.agg(
        *[F.count_if(F.col(columns[i]) < low).alias(f"b{i}_{j}") for i, j, low, _ in wanted]
    ).first()
    brackets = F.array(
        *[
            F.when(
                F.col(columns[i]).between(low, high),
                F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(columns[i]).alias("v")),
            )
            for i, j, low, high in wanted
        ]
    )
    # A bracket is cut into equal steps, so that ranking it is not one task's work.
    step = F.lit(0)
    for i, j, low, high in wanted:
        if high > low:
            share = (F.col("v") - low) / F.lit(high - low)
            step = F.when((F.col("i") == i) & (F.col("j") == j), F.floor(share * STEPS)).otherwise(step)
    inside = (
        numbers.select(F.explode(F.array_compact(brackets)).alias("q"))
        .select("q.*")
        .groupBy("i", "j", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_step", step)
    )
    inside = cumulative_counts(inside, ["i", "j"], "v", "_step")
    picks = []
    for i, j, _, _ in wanted:
        position = probabilities[j] * (sizes[f"n{i}"] - 1)
        for side, index in enumerate((int(position), min(int(position) + 1, sizes[f"n{i}"] - 1))):
            need = index + 1 - below[f"b{i}_{j}"]
            picks.append((i, j, side, need))
    hit = lambda i, j, need: (F.col("i") == i) & (F.col("j") == j) & (F.col("rank") >= need)
    found = inside.agg(
        *[F.min(F.when(hit(i, j, need), F.col("v"))).alias(f"v{i}_{j}_{side}") for i, j, side, need in picks]
    ).first()
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for i, j, _, _ in wanted:
        position = probabilities[j] * (sizes[f"n{i}"] - 1)
        low, high = found[f"v{i}_{j}_0"], found[f"v{i}_{j}_1"]
        result[columns[i]][j] = low + (high - low) * (position - int(position))
    return result


def grouped_medians(df: DataFrame, key: str, column: str, width: float) -> DataFrame:
    """Exact median of a bounded measure (a coordinate) for every key.

    Equal values collapse before the shuffle, and values are ranked per key and
    range of ``width``, so one key with most of the rows still spreads out.
    """
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(key, column)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_bucket", F.floor(F.col(column) / width))
    )
    ranked = cumulative_counts(counts, [key], column, "_bucket")
    first = F.floor((F.col("size") - 1) / 2) + 1
    second = F.floor(F.col("size") / 2) + 1
    pick = lambda k: F.min(F.when(F.col("rank") >= k, F.col(column)))
    return ranked.groupBy(key).agg(((pick(first) + pick(second)) / 2).alias(f"median_{column}"))
