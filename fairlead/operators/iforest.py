"""Isolation Forest (Liu, Ting and Zhou, 2008) trained and applied on Spark.

A tree needs only a few hundred rows, so training draws one bounded pool of rows
by hash, deals it out to the trees and grows every tree in its own group.
Scoring is a vectorised pandas UDF over the model's node arrays.
"""

from __future__ import annotations

import json
import math
from collections import deque
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fairlead.functions import coerce
from fairlead.functions.fence import evaluate_once
from fairlead.operators.ranking import exact_quantiles
from fairlead.schema import MODEL_FEATURES, MOTION_FEATURES, TURN_FEATURES
from fairlead.session import cut_lineage

TREES = 200
SEED = 42
#: Default number of rows a tree is grown on.
MAX_SAMPLES = 256
MOTION_MINUTES = 10.0
TURN_KNOTS = 3.0
_EULER = 0.5772156649015329
_NODES = "tree int, node int, feature int, threshold double, child int, depth int, rows int"


def context_mask(df: DataFrame) -> DataFrame:
    """Model features with values blanked where they mean little.

    No motion feature without a gap of at most ten minutes, no turn feature
    below three knots.
    """
    missing = sorted(set(MODEL_FEATURES) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required ML feature columns: {', '.join(missing)}")
    clean = df.withColumns({c: coerce.finite_or_null(coerce.number(df, c)) for c in MODEL_FEATURES})
    gap, sog = F.col("reporting_gap_minutes"), F.col("sog")
    short = (gap > 0.0) & (gap <= MOTION_MINUTES)
    masked = {}
    for c in MOTION_FEATURES:
        usable = short & (sog >= TURN_KNOTS) if c in TURN_FEATURES else short
        masked[c] = F.when(usable, F.col(c))
    return clean.withColumns(masked)


def feature_medians(masked: DataFrame) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(masked, list(MODEL_FEATURES), [0.5]).items()}


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Fill missing features with the learnt medians."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None}
    )


def average_path(rows) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``rows`` points."""
    n = np.asarray(rows, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, tree: int, seed: int, limit: int) -> pd.DataFrame:
    """Nodes of one random tree in breadth-first order.

    ``child`` is the left child, the right one follows it. A leaf is its own
    child and has an infinite threshold, so a walk that reached it stays there.
    """
    chance = np.random.default_rng([seed, tree])
    nodes: list[tuple] = []
    waiting = deque([(np.arange(len(points)), 0)])
    assigned = 1
    while waiting:
        rows, depth = waiting.popleft()
        number = len(nodes)
        feature, threshold, child = 0, math.inf, number
        if depth < limit and len(rows) > 1:
            low, high = points[rows].min(axis=0), points[rows].max(axis=0)
            varying = np.flatnonzero(high > low)
            if len(varying):
                feature = int(chance.choice(varying))
                threshold = float(chance.uniform(low[feature], high[feature]))
                child, assigned = assigned, assigned + 2
                goes_left = points[rows, feature] <= threshold
                waiting.append((rows[goes_left], depth + 1))
                waiting.append((rows[~goes_left], depth + 1))
        nodes.append((tree, number, feature, threshold, child, depth, len(rows)))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])


@dataclass(frozen=True)
class Forest:
    """Fitted model: one small table of nodes, the medians and the cut-off."""

    nodes: DataFrame
    features: tuple[str, ...]
    medians: dict[str, float | None]
    subsample: int
    offset: float

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        head = json.dumps(
            {"features": self.features, "medians": self.medians, "subsample": self.subsample, "offset": self.offset}
        )
        spark = self.nodes.sparkSession
        spark.createDataFrame([(head,)], "head string").write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        head = json.loads(spark.read.parquet(f"{path}/head").first().head)
        return cls(
            spark.read.parquet(f"{path}/nodes"), tuple(head["features"]), head["medians"], head["subsample"], head["offset"]
        )


def _training_pool(prepared: DataFrame, rows: int, seed: int, row_id: str, total: int | None = None) -> DataFrame:
    """The first ``rows`` rows in hash order, the same for any partitioning.

    From the number of rows follows a hash below which a few more than that lie, so
    the tasks together hand over little more than the pool, however many they are.
    Should there be fewer after all, the cut-off is moved up.
    """
    mixed = prepared.withColumn("_mix", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row_id)), 1))
    total = prepared.count() if total is None else total
    share = (rows + 6 * math.sqrt(rows) + 16) / max(total, 1)
    while share < 1:
        few = mixed.filter(F.col("_mix") < int(share * 2**63))
        if few.count() >= rows:
            mixed = few
            break
        share *= 2
    return mixed.orderBy("_mix", row_id).limit(rows)


def fit(
    df: DataFrame,
    trees: int = TREES,
    contamination: str | float = "auto",
    seed: int = SEED,
    row_id: str = "id",
    max_samples: int = MAX_SAMPLES,
) -> Forest:
    """Train on engineered features; the result depends on the rows, not on their layout.

    Each tree is grown on at most ``max_samples`` rows, so the forest sees at most
    ``trees`` x ``max_samples`` rows; medians and the cut-off use all rows.
    """
    # Read by the medians several times and by the pool.
    masked = cut_lineage(context_mask(df).select(row_id, *MODEL_FEATURES))
    any_value = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in MODEL_FEATURES])
    sizes = masked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_value).alias("filled")).first()
    if sizes.rows < 2:
        raise ValueError("At least 2 observations are required to train the detector.")
    if sizes.filled == 0:
        raise ValueError("All model feature values are missing.")
    medians = feature_medians(masked)
    features = tuple(c for c in MODEL_FEATURES if medians[c] is not None)
    prepared = impute(masked, medians).select(row_id, *features)
    subsample = min(max_samples, sizes.rows)
    pool_rows = min(sizes.rows, trees * max_samples)
    per_pass = max(1, pool_rows // subsample)
    passes = math.ceil(trees / per_pass)
    limit = max(1, math.ceil(math.log2(max(subsample, 2))))
    # Every pass shuffles the pool anew and deals disjoint blocks to its trees.
    # passes x pool never exceeds about two rounds of trees x max_samples rows.
    again = Window.partitionBy("_pass").orderBy("_deal", row_id)
    dealt = (
        _training_pool(prepared, trees * max_samples, seed, row_id, sizes.rows)
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("_deal", F.xxhash64(F.lit(seed), F.col("_pass"), F.col(row_id)))
        .withColumn("_block", F.floor((F.row_number().over(again) - 1) / subsample))
        .withColumn("tree", (F.col("_pass") * per_pass + F.col("_block")).cast("int"))
        .filter((F.col("_block") < per_pass) & (F.col("tree") < trees))
    )
    names = list(features)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        points = group.sort_values("_deal")[names].to_numpy(float)
        return _grow(points, int(group["tree"].iloc[0]), seed, limit)

    # A fixed partition count: the rows are few, the work per tree is not.
    spread = dealt.repartition(min(trees, df.sparkSession.sparkContext.defaultParallelism), "tree")
    nodes = cut_lineage(spread.groupBy("tree").applyInPandas(grow, _NODES))
    forest = Forest(nodes, features, medians, subsample, -0.5)
    if contamination != "auto":
        raw = score(df, forest).select((F.col("ml_decision_function") + forest.offset).alias("raw"))
        offset = exact_quantiles(raw, ["raw"], [float(contamination)])["raw"][0]
        forest = Forest(nodes, features, medians, subsample, offset)
    return forest


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Add decision function, anomaly score (its negative) and verdict.

    At most 200 x 511 nodes travel to the executors, whatever the data size.
    """
    table = forest.nodes.orderBy("tree", "node").toPandas()
    starts = table.groupby("tree")["node"].transform("size")
    roots = np.flatnonzero(table["node"].to_numpy() == 0)
    base = np.repeat(roots, starts.iloc[roots].to_numpy())
    # Index types that numpy need not convert at every step.
    feature = table["feature"].to_numpy(np.intp)
    threshold = table["threshold"].to_numpy()
    child = (table["child"].to_numpy() + base).astype(np.intp)
    ends = table["depth"].to_numpy() + average_path(table["rows"].to_numpy())
    depth = int(table["depth"].max())
    scale = float(average_path(forest.subsample)) or 1.0
    model = df.sparkSession.sparkContext.broadcast((feature, threshold, child, ends, roots.astype(np.intp)))

    @F.pandas_udf("double")
    def raw_score(*columns: pd.Series) -> pd.Series:
        feature, threshold, child, ends, roots = model.value
        values = np.column_stack([c.to_numpy(float) for c in columns])
        out = np.empty(len(values))
        for start in range(0, len(values), 1024):  # keep the index matrix in cache
            block = values[start : start + 1024]
            cells = block.ravel()
            first = (np.arange(len(block), dtype=np.intp) * block.shape[1])[:, None]
            at = np.repeat(roots[None, :], len(block), axis=0)
            for _ in range(depth):
                beyond = cells.take(first + feature.take(at)) > threshold.take(at)
                at = child.take(at) + beyond
            out[start : start + 1024] = -np.power(2.0, -ends.take(at).mean(axis=1) / scale)
        return pd.Series(out)

    # The masked, filled values are only the model's view; the reports keep their own.
    own = {c: f"_own_{c}" for c in MODEL_FEATURES}
    kept = df.withColumns({copy: F.col(c) for c, copy in own.items()})
    viewed = impute(context_mask(kept), forest.medians)
    # A filter on the score must not send the rows through the trees a second time.
    scored = evaluate_once(viewed.withColumn("_raw", raw_score(*[F.col(c) for c in forest.features])), ["_raw"])
    decision = F.col("_raw") - F.lit(forest.offset)
    results = ("ml_decision_function", "ml_anomaly_score", "ml_is_anomaly")
    reports = [F.col(own.get(c, c)).alias(c) for c in df.columns if c not in results]
    return scored.select(
        *reports,
        decision.alias("ml_decision_function"),
        (-decision).alias("ml_anomaly_score"),
        (decision < 0).alias("ml_is_anomaly"),
    )


def fit_score(df: DataFrame, **options) -> DataFrame:
    return score(df, fit(df, **options))
