"""Import of report files, as a stream of micro-batches or as one batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fairlead.functions.dates import DATE
from fairlead.operators import linking
from fairlead.operators.cleaning import check_constraints
from fairlead.operators.encounters import latest_reports
from fairlead.schema import CORE
from fairlead.session import cut_lineage, ensure_settings, temporary_stages
from fairlead.sources.files import digest_paths, file_digests, list_files
from fairlead.sources.paths import can_open, literal, qualified
from fairlead.sources.tables import days_of
from fairlead.streaming.folder import changed_files
from fairlead.streaming.registry import Job, error_text
from fairlead.streaming.stages import LIVE_STAGES, BatchContext, Stage, run_stages
from fairlead.streaming.store import Store

#: Files that are imported together; more are taken in further batches.
FILES_PER_BATCH = 256


def listing_stream(spark: SparkSession, directory: str, files_per_trigger: int = 16) -> DataFrame:
    """path of new CSV files, each offered once, by Spark's own file source.

    For file systems that only Spark's readers know; elsewhere ``changed_files``
    also offers files changed in place. Writers must move finished files into the folder.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_trigger)
        .load(directory)
    )
    return files.select("path").filter(~F.element_at(F.split("path", "/"), -1).startswith("."))


def _scan(store: Store, paths: list[str], number: int) -> DataFrame:
    """Files with one header as text columns, with the place of each row; a missing core column is an error."""
    spark = store.spark
    paths = [literal(path) for path in paths]
    names = spark.read.option("header", True).csv(paths[0]).columns
    missing = sorted(set(CORE) - set(names))
    if missing:
        raise ValueError(f"Report files lack the columns {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.option("header", True).schema(schema).csv(paths)
    place = F.monotonically_increasing_id()
    return raw.select(
        *[F.col(f"`{n}`") for n in names], F.col("_metadata.file_path").alias("_file"), place.alias("_place"),
        F.lit(number).alias("_scan"),
    )


def _staged(store: Store, jobs: Sequence[Job]) -> tuple[list[Job], list[Job], DataFrame | None]:
    """(read jobs, failed jobs, stored rows with job_id): one scan per header, the files of a broken one each alone."""
    by_header: dict[str | None, list[Job]] = {}
    failed = [job for job in jobs if job.status == "failed"]
    for job in jobs:
        if job.status == "failed":
            continue
        by_header.setdefault(job.header, []).append(job)
    waiting, good, parts = list(by_header.values()), [], []
    while waiting:
        group = waiting.pop()
        paths = [job.source_file for job in group]
        try:
            # Paths as the scan names them; the listing reads no contents.
            listed = list_files(store.spark, [literal(p) for p in paths], "*").select("path", F.col("file_uri").alias("_file"))
            known = store.spark.createDataFrame([(j.source_file, j.job_id) for j in group], "path string, job_id string")
            named = listed.join(known, "path").drop("path")
            # At most as many names as files are imported together; the rows stay where they are read.
            parts.append(cut_lineage(_scan(store, paths, len(parts)).join(F.broadcast(named), "_file").drop("_file")))
            good += group
        except Exception as error:  # noqa: BLE001
            if len(group) == 1:
                failed.append(group[0].failed(error))
            else:
                waiting += [[job] for job in group]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return good, failed, rows


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """Rows with ``id``: consecutive numbers in scan order, from one count per scan partition."""
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    sizes = rows.groupBy("_scan", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per scan partition.
    before = Window.orderBy("_scan", "_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_scan", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + first).alias("_begin"))
    number = F.col("_begin") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return rows.join(begins, ["_scan", "_part"]).withColumn("id", number).drop("_scan", "_part", "_place", "_begin")


def import_jobs(store: Store, jobs: Sequence[Job]) -> tuple[list[Job], DataFrame | None]:
    """Import the files of all jobs together; (finished jobs, keys of stored rows).

    A file that cannot be read as reports fails by itself. Counting, vessel merge
    and message insert each are one Spark job for the whole batch. Rows outside
    the stored limits go to quarantine.
    """
    good, finished, rows = _staged(store, jobs)
    if rows is None:
        store.registry.record(finished)
        return finished, None
    try:
        good, first = store.registry.reserve(good, rows.count())
        # Read by every step below, so values are parsed and tested once, for valid and rejected rows together.
        valid, rejected = linking.import_validate(_numbered(rows, first), cut_lineage)
        metadata = [c for c in ("imo", "vessel_name", "call_sign", "vessel_type", "length_m", "width_m", "draft_m") if c in rows.columns]
        store.vessels.merge_vessels(linking.vessel_dim(valid.select("mmsi", "timestamp", "id", *metadata), "id"))
        records, outside = check_constraints(cut_lineage(linking.message_project(valid, keep=("job_id",))))
        store.quarantine.append(store.quarantine.new_rows(outside, order="id"))
        fresh = store.messages.new_rows(records, order="id")
        # State first: after a crash in between, the retry finds the rows new again and
        # merges the same reports; the other order would leave the state behind.
        _keep_state(store, fresh)
        store.messages.append(fresh)
        finished += _counted(store, good, rows, valid, rejected, outside)
    except Exception as error:
        store.registry.record([*finished, *(job.failed(error) for job in good)])
        raise
    return finished, linking.incoming_keys(records)


def _counted(store: Store, jobs: Sequence[Job], rows, valid, rejected, outside) -> list[Job]:
    """Completed jobs with their counters: one row per file.

    Imported is what is stored of a job, so an attempt that was cut short after
    its insert counts what it had inserted.
    """
    days = valid.groupBy("job_id").agg(
        F.min(F.to_date("timestamp")).alias("first_day"), F.max(F.to_date("timestamp")).alias("last_day")
    )
    counted = lambda df, name: df.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))
    kept = store.messages.read().filter(F.col(DATE).isin(days_of(valid.withColumn(DATE, F.to_date("timestamp")))))
    numbers = (
        counted(rows, "rows_read")
        .join(counted(rejected, "rows_rejected"), "job_id", "left")
        .join(counted(outside, "rows_quarantined"), "job_id", "left")
        .join(counted(kept.filter(F.col("job_id").isin([j.job_id for j in jobs])), "rows_imported"), "job_id", "left")
        .fillna(0)
        .join(days, "job_id", "left")
    )
    by_job = {r.job_id: r.asDict() for r in numbers.collect()}
    done = []
    for job in jobs:
        c = by_job.get(job.job_id, {})
        names = ("rows_read", "rows_imported", "rows_rejected", "rows_quarantined")
        read, new, bad, out = (c.get(n, 0) for n in names)
        done.append(
            job.completed(
                **dict(zip(names, (read, new, bad, out))), duplicates_skipped=read - bad - out - new,
                first_day=c.get("first_day"), last_day=c.get("last_day"),
            )
        )
    return done


def _keep_state(store: Store, fresh: DataFrame) -> None:
    """Bring the newest report per vessel, overall and per day, up to date."""
    known = store.latest.read()
    store.latest.replace(latest_reports(known.unionByName(fresh.select(known.columns))))
    dated = fresh.withColumn("day", F.to_date("timestamp")).withColumn(DATE, F.col("day"))
    stored = store.day_ends.read().filter(F.col(DATE).isin(days_of(dated)))
    both = stored.unionByName(dated.select(stored.columns))
    newest = Window.partitionBy("mmsi", "day").orderBy(F.desc("timestamp"), F.desc("id"))
    store.day_ends.upsert(both.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1"), order="timestamp")


def ingest_batch(
    store: Store, files: DataFrame, stages: Sequence[Stage] | None = LIVE_STAGES, most: int = FILES_PER_BATCH
) -> list[Job]:
    """Claim, import, then analyse what was imported; ``most`` files at a time until all were tried.

    Analytics run for every file of which rows are stored, also if an earlier
    attempt stored them. Their failure does not undo the import; it is recorded
    with the job, so ``retry_analytics`` can repeat them.
    """
    ensure_settings(store.spark)
    outcome: list[Job] = []
    begun = datetime.now(timezone.utc)
    with temporary_stages(store.spark):
        files = cut_lineage(files)
        while jobs := store.registry.claim(files, most, begun):
            try:
                # Copies made by the import are gone before analytics begin.
                with temporary_stages(store.spark):
                    finished, keys = import_jobs(store, jobs)
                    batch = _kept_keys(finished, keys, stages)
                outcome += _analyse(store, finished, batch, stages)
            finally:
                store.registry.release(jobs)
    return outcome


def _kept_keys(finished: list[Job], keys: DataFrame | None, stages: Sequence[Stage] | None) -> BatchContext | Exception | None:
    """What analytics read of an import, if they are to run; its failure is theirs."""
    if stages is None or not any(j.status == "completed" and j.rows_imported > 0 for j in finished):
        return None
    try:
        return BatchContext(cut_lineage(keys, outer=True))
    except Exception as problem:  # noqa: BLE001
        return problem


def _analyse(
    store: Store, finished: list[Job], batch: BatchContext | Exception | None, stages: Sequence[Stage] | None
) -> list[Job]:
    status, error = ("not_requested", None) if stages is None else ("completed", None)
    if batch is not None:
        try:
            if isinstance(batch, Exception):
                raise batch
            run_stages(store, batch, stages)
        except Exception as problem:  # noqa: BLE001
            status, error = "failed", error_text(problem, "Unknown analytics error.")
    outcome = []
    for job in finished:
        if job.status != "completed":
            outcome.append(job)
        elif stages is not None and job.rows_imported == 0:
            outcome.append(replace(job, analytics_status="skipped"))
        else:
            outcome.append(replace(job, analytics_status=status, analytics_error=error))
    store.registry.record(outcome)
    return outcome


def ingest_directory(store: Store, directory: str, stages: Sequence[Stage] | None = LIVE_STAGES) -> list[Job]:
    """One pass over a folder: everything not completed yet, changed contents included."""
    return ingest_batch(store, file_digests(store.spark, directory), stages)


def start_ingestion(
    store: Store,
    directory: str,
    checkpoint: str,
    stages: Sequence[Stage] | None = LIVE_STAGES,
    files_per_trigger: int = 16,
    **trigger,
) -> StreamingQuery:
    """Continuous ingestion. A repeated micro-batch is harmless: all writes are keyed.

    A trigger takes every new or changed file and imports them in bounded parts.
    Where only Spark's readers reach the files, it takes ``files_per_trigger`` new ones.
    """
    spark = ensure_settings(store.spark)
    # A restarted stream goes on with the jobs it held; a checkpoint has one stream at a time.
    store = replace(store, owner=qualified(spark, checkpoint))
    direct = can_open(qualified(spark, directory)) and can_open(qualified(spark, checkpoint))

    def process(batch: DataFrame, batch_id: int) -> None:
        if direct:
            files = batch
        else:
            # At most files_per_trigger names.
            paths = [r.path for r in batch.collect()]
            if not paths:
                return
            files = file_digests(spark, paths)
        ingest_batch(store, files, stages)

    if direct:
        stream = changed_files(spark, directory, f"{checkpoint.rstrip('/')}/offered")
    else:
        stream = listing_stream(spark, directory, files_per_trigger)
    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def retry_failed(store: Store, stages: Sequence[Stage] | None = LIVE_STAGES) -> list[Job]:
    """Try files again whose last attempt failed or was cut short; their digests are taken anew.

    They are taken FILES_PER_BATCH at a time. A file is known by what it holds now.
    """
    begun, outcome = datetime.now(timezone.utc), []
    while True:
        again = F.col("status").isin("pending", "running", "failed") & (F.col("started_at") < F.lit(begun))
        # Jobs another driver is at are not lost.
        again = again & ~F.col("job_id").isin(store.registry.leases.of_others())
        open_jobs = store.registry.jobs().filter(again).orderBy("job_id").limit(FILES_PER_BATCH).collect()
        if not open_jobs:
            return outcome
        files = digest_paths(store.spark, {r.source_file: r.size_bytes for r in open_jobs})
        done = ingest_batch(store, files, stages)
        known = {job.job_id for job in done}
        # What was tried under an identity the file no longer has is closed.
        store.registry.record(replace(_as_job(r), status="superseded") for r in open_jobs if r.job_id not in known)
        outcome += done


def retry_analytics(store: Store, stages: Sequence[Stage] = LIVE_STAGES) -> bool:
    """Repeat the analytics of imports whose analytics failed; True when there were any."""
    failed = store.registry.jobs().filter("analytics_status = 'failed'")
    # One row per file, with the days its reports lie on.
    jobs = [_as_job(r) for r in failed.collect()]
    if not jobs:
        return False
    days = [d for j in jobs for d in (j.first_day, j.last_day) if d is not None]
    stored = store.messages.read()
    if days:
        stored = stored.filter(F.col(DATE).between(F.lit(min(days)), F.lit(max(days))))
    ids = failed.select("job_id")
    keys = stored.join(ids, "job_id", "left_semi").select("mmsi", "timestamp").distinct()
    with temporary_stages(store.spark):
        run_stages(store, BatchContext(cut_lineage(keys)), stages)
    store.registry.record(replace(j, analytics_status="completed", analytics_error=None) for j in jobs)
    return True


def _as_job(row) -> Job:
    values = row.asDict()
    return Job(**{k: values[k] for k in Job.__dataclass_fields__})
