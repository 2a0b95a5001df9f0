"""Analytics that follow an import, in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, Window, functions as F

from fairlead.operators import encounters, hybrid, iforest, linking, motion, ranking, rules
from fairlead.session import cut_lineage, delete_path, temporary_stages
from fairlead.functions.dates import DATE
from fairlead.schema import MODEL_FEATURES
from fairlead.sources.tables import _exists, days_of
from fairlead.streaming.store import Store

RISK_VERSION = linking.RISK_VERSION


@dataclass
class BatchContext:
    """What an imported batch brings: the identities of its valid rows.

    Stages that need the annotated reports of the batch share one stored copy.
    """

    keys: DataFrame
    _annotated: dict[bool, DataFrame] = field(default_factory=dict)

    def annotated(self, store: Store, successors: bool = False) -> DataFrame:
        if successors not in self._annotated:
            # They outlive the stage that asks first.
            keys = cut_lineage(with_successors(store, self.keys), outer=True) if successors else self.keys
            self._annotated[successors] = cut_lineage(annotated_batch(store, keys), outer=True)
        return self._annotated[successors]


@dataclass(frozen=True)
class StageResult:
    name: str
    processed: int = 0
    created: int = 0


Stage = Callable[[Store, BatchContext], StageResult]


class StageError(RuntimeError):
    """A stage failed; earlier results stay stored."""

    def __init__(self, name: str, finished: Sequence[StageResult], cause: Exception) -> None:
        super().__init__(f"{name}: {cause}")
        self.finished = tuple(finished)


def run_stages(store: Store, batch: BatchContext, stages: Sequence[Stage]) -> tuple[StageResult, ...]:
    """Run in order, stop at the first failure. What a stage stored for itself is gone before the next one begins."""
    results: list[StageResult] = []
    for stage in stages:
        try:
            with temporary_stages(store.spark):
                results.append(stage(store, batch))
        except Exception as error:
            raise StageError(getattr(stage, "__name__", "stage"), results, error) from error
    return tuple(results)


def annotated_batch(store: Store, keys: DataFrame) -> DataFrame:
    """Annotated reports of the keys; older reports only give them their context."""
    return linking.restrict_to_incoming(rules.annotate(motion.live_features(context_of(store, keys))), keys)


def context_of(store: Store, keys: DataFrame) -> DataFrame:
    """All reports that can be a predecessor of a batch row, without the full history.

    A predecessor lies on the same day, or is the last report of an earlier one.
    So the batch's own days are read in full, and of other days only their last
    reports; before the first day, only the newest of those.
    """
    days = days_of(keys.withColumn(DATE, F.to_date("timestamp")))
    messages, ends = store.messages.read(), store.day_ends.read()
    columns = [c for c in messages.columns if c != DATE]
    if not days:
        return messages.select(columns).limit(0)
    same_days = messages.filter(F.col(DATE).isin(days))
    between_days = ends.filter((F.col(DATE) > min(days)) & (F.col(DATE) < max(days)) & ~F.col(DATE).isin(days))
    before = encounters.latest_reports(ends.filter(F.col(DATE) < min(days)))
    possible = same_days.select(columns).unionByName(between_days.select(columns)).unionByName(before.select(columns))
    return linking.affected_history(possible, keys)


def with_successors(store: Store, keys: DataFrame) -> DataFrame:
    """The keys, and the stored report that follows each of them: the one whose predecessor may have changed.

    The follower lies on the same day, or is the first report of the vessel's next
    day. Which day that is, the table of day ends tells without reading reports, so
    only the keys' days and those next days are read.
    """
    keys = keys.select("mmsi", "timestamp").distinct()
    own_days = keys.select("mmsi", F.to_date("timestamp").alias("day"), F.lit(True).alias("asked")).distinct()
    vessels = keys.select("mmsi").distinct()
    known = store.day_ends.read().select("mmsi", "day").join(vessels, "mmsi", "left_semi")
    # One row per vessel and day: few beside the reports.
    along = Window.partitionBy("mmsi").orderBy("day")
    ahead = known.join(own_days, ["mmsi", "day"], "left").select(
        "mmsi", "day", "asked", F.lead("day").over(along).alias("next_day")
    )
    ahead = cut_lineage(ahead.filter("asked"))
    reads = cut_lineage(
        ahead.select("mmsi", "day").unionByName(ahead.select("mmsi", F.col("next_day").alias("day"))).dropna().distinct()
    )
    days = [r["day"] for r in reads.select("day").distinct().collect()]
    near = store.messages.read().filter(F.col(DATE).isin(days)).select("mmsi", "timestamp", F.col(DATE).alias("day"))
    times = near.join(reads, ["mmsi", "day"], "left_semi").distinct()
    # Per vessel and day: the next time inside the day, and the day's first for the day before.
    inside = Window.partitionBy("mmsi", "day").orderBy("timestamp")
    times = times.withColumn("next", F.lead("timestamp").over(inside))
    firsts = times.groupBy("mmsi", F.col("day").alias("next_day")).agg(F.min("timestamp").alias("first"))
    border = ahead.join(firsts, ["mmsi", "next_day"]).select("mmsi", "day", "first")
    asked = times.join(keys, ["mmsi", "timestamp"], "left_semi").join(border, ["mmsi", "day"], "left")
    followers = asked.select("mmsi", F.coalesce("next", "first").alias("timestamp")).dropna()
    return keys.unionByName(followers).distinct()


def rule_stage(store: Store, batch: BatchContext, successors: bool = False) -> StageResult:
    """Alerts of the batch's reports.

    Late reports only bring their own; with ``successors`` the report that follows
    a late one is judged again, and its alerts that no longer hold are deleted.
    """
    incoming = batch.annotated(store, successors)
    alerts = rules.explode_alerts(incoming, keep=("id",)).withColumnRenamed("id", "message_id")
    if successors:
        judged = incoming.select(F.col("id").alias("message_id"), "timestamp")
        written = store.alerts.exchange(judged, alerts, order="threshold")
    else:
        written = store.alerts.upsert(alerts, order="threshold")
    return StageResult("rule_anomalies", incoming.count(), written)


@dataclass(frozen=True)
class Baseline:
    """Model and score distribution learnt from one reference day; ``version`` names the day."""

    forest: iforest.Forest
    reference: ranking.ScoreReference
    version: str

    @classmethod
    def fit(cls, day: DataFrame, version: str, trees: int = iforest.TREES) -> "Baseline":
        """Learn from the reports of a day; fewer than two are an error."""
        # What model and scores read, no more.
        annotated = cut_lineage(rules.annotate(motion.live_features(day)).select("id", *MODEL_FEATURES))
        if annotated.limit(2).count() < 2:
            raise RuntimeError(f"The reference day {version} has fewer than two reports to learn from.")
        forest = iforest.fit(annotated, trees=trees)
        return cls(forest, ranking.fit_reference(iforest.score(annotated, forest)), version)

    def save(self, path: str) -> None:
        self.forest.save(f"{path}/forest")
        self.reference.save(f"{path}/scores")

    @classmethod
    def load(cls, spark, path: str, version: str) -> "Baseline":
        forest, scores = iforest.Forest.load(spark, f"{path}/forest"), ranking.ScoreReference.load(spark, f"{path}/scores")
        return cls(forest, scores, version)


def baseline_day(store: Store, as_of: date | None = None) -> tuple[date, str] | None:
    """Reference day and version of the baseline as of a day (by default the newest stored one).

    The densest of the days before it, the earliest on a tie: those are complete,
    so a model is not moved by a day that still grows. Only while there is no
    earlier day the day itself is taken, under a version of its own. Days are
    counted by partition, no column of the reports is read.
    """
    days = store.messages.read().groupBy(DATE).count()
    newest = days.filter(F.lit(True) if as_of is None else F.col(DATE) <= F.lit(as_of)).agg(F.max(DATE)).first()[0]
    if newest is None:
        return None
    best = days.filter(F.col(DATE) < F.lit(newest)).orderBy(F.desc("count"), DATE).first()
    return (newest, f"{newest}.open") if best is None else (best[DATE], str(best[DATE]))


def load_baseline(store: Store, version: str) -> Baseline | None:
    """A stored version; None while it is not complete."""
    path = f"{store.baseline_path}/{version}"
    return Baseline.load(store.spark, path, version) if _exists(store.spark, f"{path}/scores/head/_SUCCESS") else None


def stored_baseline(store: Store, trees: int = iforest.TREES, as_of: date | None = None) -> Baseline:
    """The baseline as of a day, learnt when its reference day is first needed and never changed after that."""
    chosen = baseline_day(store, as_of)
    if chosen is None:
        raise RuntimeError("There are no stored reports to learn a baseline from.")
    day, version = chosen
    known = load_baseline(store, version)
    if known is None:
        reports = store.messages.read().filter(F.col(DATE) == F.lit(day)).drop(DATE)
        path = f"{store.baseline_path}/{version}"
        delete_path(store.spark, path)
        Baseline.fit(reports, version, trees).save(path)
        known = load_baseline(store, version)
    return known


def risk_version(baseline: Baseline) -> str:
    return f"{RISK_VERSION}@{baseline.version}"


def risk_stage(store: Store, batch: BatchContext, successors: bool = False) -> StageResult:
    """Assess the batch's reports with the baseline of the stored days; each assessment names its version."""
    incoming = batch.annotated(store, successors)
    processed = incoming.count()
    if not processed:
        return StageResult("hybrid_risk")
    baseline = stored_baseline(store)
    # The motion features end here: assessments keep none of them.
    kept = ("id", "mmsi", "timestamp", "latitude", "longitude", "ml_anomaly_score", *hybrid.FLAGS)
    scored = cut_lineage(iforest.score(incoming, baseline.forest).select(*kept))
    assessed = cut_lineage(hybrid.assess(scored, baseline.reference))
    good, bad = linking.risk_validate(assessed)
    broken = bad.count()
    if broken:
        raise RuntimeError(f"Hybrid risk produced {broken} invalid row(s).")
    version = F.lit(risk_version(baseline))
    records = good.withColumn("message_id", F.col("id")).withColumn("assessment_version", version)
    return StageResult("hybrid_risk", processed, store.risks.upsert(records, order="message_id"))


def collision_stage(store: Store, batch: BatchContext) -> StageResult:
    """Look for encounters of the vessels whose newest report came with the batch, among all vessels.

    Pairs of two vessels that did not change were looked at when they last did.
    """
    latest = store.latest.read()
    new = batch.keys.select("mmsi", "timestamp").distinct().withColumn("_changed", F.lit(True))
    flagged = latest.join(new, ["mmsi", "timestamp"], "left").fillna(False, ["_changed"])
    snapshot = encounters.snapshot_of(flagged, "_changed")
    return _store_encounters(store, snapshot, encounters.encounter_records(snapshot, changed="_changed"))


def full_collision_stage(store: Store, batch: BatchContext) -> StageResult:
    """Scan the latest state of all vessels, whatever changed: to fill a store whose stages did not run."""
    snapshot = encounters.snapshot_of(store.latest.read())
    return _store_encounters(store, snapshot, encounters.encounter_records(snapshot))


def _store_encounters(store: Store, snapshot: DataFrame, found: DataFrame) -> StageResult:
    """Two states meet once, so no encounter comes twice where no two states have one report number: few rows tell for all pairs."""
    distinct = snapshot.groupBy("id").count().filter("count > 1").isEmpty()
    offered, inserted = store.encounters.insert_new(found, order="message_a", distinct=distinct)
    return StageResult("collision_snapshot", offered, inserted)


LIVE_STAGES: tuple[Stage, ...] = (rule_stage, risk_stage, collision_stage)


def _successors_too(stage: Callable[..., StageResult]) -> Stage:
    @wraps(stage)
    def run(store: Store, batch: BatchContext) -> StageResult:
        return stage(store, batch, successors=True)

    return run


#: Stages that also judge the stored followers of late reports again, so that results do not depend on the order of delivery.
RECOMPUTING_STAGES: tuple[Stage, ...] = (_successors_too(rule_stage), _successors_too(risk_stage), collision_stage)
