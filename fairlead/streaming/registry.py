"""Import jobs by file content: what was seen, what is done, what may be retried.

State changes of a batch are one write. They form a log next to a compacted
base; the current state of a file is its newest row. A job is known by the full
digest of its content. Several drivers may work on one store: a job is leased to
one of them, and ranges of row ids are given out once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.operators.linking import last_per_key
from fairlead.session import delete_path
from fairlead.sources.tables import VersionedTable, _children
from fairlead.streaming.claims import Leases, next_range

_SCHEMA = (
    "job_id string, source_file string, size_bytes bigint, header string, status string, rows_read bigint, "
    "rows_imported bigint, rows_rejected bigint, rows_quarantined bigint, duplicates_skipped bigint, "
    "error_message string, analytics_status string, analytics_error string, first_day date, last_day date, "
    "next_id bigint, started_at timestamp, finished_at timestamp, recorded bigint"
)
#: Batches in the log after which it is compacted.
COMPACT_AFTER = 64
#: After this time others may take over a job that its driver neither finished nor released.
LEASE_SECONDS = 6 * 3600.0


@dataclass(frozen=True)
class Job:
    """One import job; ``job_id`` is the SHA-256 of the content, so a repeat finds itself."""

    job_id: str
    source_file: str
    size_bytes: int
    header: str | None = None
    status: str = "pending"
    rows_read: int = 0
    rows_imported: int = 0
    rows_rejected: int = 0
    rows_quarantined: int = 0
    duplicates_skipped: int = 0
    error_message: str | None = None
    analytics_status: str | None = None
    analytics_error: str | None = None
    first_day: date | None = None
    last_day: date | None = None
    next_id: int = 0
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    finished_at: datetime | None = None

    def completed(self, **counters) -> "Job":
        return replace(
            self, status="completed", error_message=None, finished_at=datetime.now(timezone.utc), **counters
        )

    def failed(self, error: object) -> "Job":
        message = error_text(error, "Unknown ingestion error.")
        return replace(self, status="failed", finished_at=datetime.now(timezone.utc), error_message=message)


def error_text(error: object, otherwise: str) -> str:
    return str(error).strip() or otherwise


@dataclass(frozen=True)
class FileRegistry:
    spark: SparkSession
    path: str
    #: Name of the driver; a restarted one with the same name goes on with its own jobs at once.
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    lease_seconds: float = LEASE_SECONDS

    @property
    def leases(self) -> Leases:
        return Leases(self.spark, f"{self.path}/leases", self.owner, self.lease_seconds)

    @property
    def _base(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/base", _SCHEMA)

    def _batches(self) -> list[str]:
        return [n for n in _children(self.spark, f"{self.path}/log") if n.startswith("batch=")]

    def _rows(self) -> DataFrame:
        base = self._base.read()
        if not self._batches():
            return base
        log = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/log")
        return base.unionByName(log.select(base.columns))

    def jobs(self) -> DataFrame:
        """Current state of every job."""
        return last_per_key(self._rows(), ("job_id",), "recorded")

    def record(self, jobs: Iterable[Job]) -> None:
        """All state changes of a batch in one write."""
        now = time.time_ns()
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        rows = [tuple({**asdict(job), "recorded": now + i}[c] for c in names) for i, job in enumerate(jobs)]
        if rows:
            self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{self.path}/log/batch={now}")
            if len(self._batches()) > COMPACT_AFTER:
                self.compact()

    def compact(self) -> None:
        """Replace base and log by the current states; a crash in between only leaves rows twice."""
        merged = self._batches()
        self._base.replace(self.jobs())
        for name in merged:
            delete_path(self.spark, f"{self.path}/log/{name}")

    def claim(self, files: DataFrame, most: int, since: datetime | None = None) -> list[Job]:
        """At most ``most`` jobs to process for these files (columns of ``file_digests``), by name.

        New content starts pending; pending or failed content may be tried again,
        but not if that was ``since`` the given time; completed content is skipped
        for good. Equal files are one job. A file that could not be read is a failed job.
        Jobs that another driver holds are left to it. ``release`` what is returned
        once its outcome is recorded.
        """
        leases = self.leases
        while True:
            rows = self._open(files, since, leases.of_others()).orderBy("name", "path").limit(most).collect()
            if not rows:
                return []
            mine = leases.take(r.content_sha256 for r in rows)
            # Another driver may have finished and released a job after it was looked up here.
            still = {r.content_sha256 for r in self._open(files, since, []).filter(F.col("content_sha256").isin(mine)).collect()}
            leases.release(key for key in mine if key not in still)
            rows = [r for r in rows if r.content_sha256 in still]
            if rows:
                break
        jobs = [Job(f.content_sha256, f.path, f.size_bytes, f.header) for f in rows]
        jobs = [job if f.error is None else job.failed(f.error) for job, f in zip(jobs, rows)]
        self.record(jobs)
        return jobs

    def _open(self, files: DataFrame, since: datetime | None, held: Sequence[str]) -> DataFrame:
        """One row per content that may be tried now."""
        closed = F.col("status").isin("completed", "superseded")
        if since is not None:
            closed = closed | (F.col("started_at") >= F.lit(since))
        done = self.jobs().filter(closed).select(F.col("job_id").alias("content_sha256"))
        # A file that could not be read is known by its name until it can be.
        error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
        known = F.coalesce("content_sha256", F.sha2(F.concat(F.lit("unreadable "), "path"), 256))
        files = files.withColumns({"error": error, "content_sha256": known})
        first = files.groupBy("content_sha256").agg(F.min(F.struct("name", "path", "size_bytes", "header", "error")).alias("f"))
        found = first.join(done, "content_sha256", "left_anti").select("content_sha256", "f.*")
        return found.filter(~F.col("content_sha256").isin(list(held)))

    def release(self, jobs: Iterable[Job]) -> None:
        self.leases.release(job.job_id for job in jobs)

    def reserve(self, jobs: Sequence[Job], rows: int) -> tuple[list[Job], int]:
        """Row ids for a batch: the first one. Written down before any row is, so none is given twice."""
        known = self._rows().agg(F.max("next_id")).first()[0] or 0
        first = next_range(self.spark, f"{self.path}/row_ids", rows, known)
        running = [replace(job, status="running", next_id=first + rows) for job in jobs]
        self.record(running)
        return running, first
