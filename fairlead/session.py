"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}
_local = threading.local()


def local_session(app: str = "fairlead", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return ensure_settings(session)


_SETTINGS = {
    # All report times are UTC; parsing and day arithmetic depend on it.
    "spark.sql.session.timeZone": "UTC",
    # The default INT96 has no statistics, so time filters could not skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only where the session names none and runs in one process (tests, a laptop)
    is a local folder made; a cluster without one is an error.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"A cluster must name a shared folder in {CHECKPOINT_KEY}.")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="fairlead-")
        configured = _own_folders[app]
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written intermediate table."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, outer: bool = False) -> DataFrame:
    """Store an intermediate result once in the shared folder and read it back.

    Used where several branches read the same expensive input. The copy is a
    plain Parquet table, so it outlives lost executors, keeps column pruning and
    carries size statistics for join planning. ``outer``: it also outlives the
    innermost ``temporary_stages``, for what comes after that.
    """
    spark = df.sparkSession
    path = _stage_path(spark, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """Like ``cut_lineage``, as a table partitioned by a column; with its path, so that its files may be moved."""
    spark = df.sparkSession
    path = _stage_path(spark)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _stage_path(spark: SparkSession, outer: bool = False) -> str:
    path = scratch_path(spark, "stage")
    scopes = getattr(_local, "scopes", [])
    if scopes := scopes[:-1] if outer else scopes:
        scopes[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table of our own, wherever the shared folder lives."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Remove the stored intermediate results made inside when leaving.

    For long-running ingestion, whose batches would fill the folder otherwise.
    Results must not be read afterwards.
    """
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    paths: list[str] = []
    _local.scopes.append(paths)
    try:
        yield
    finally:
        # The last one: scopes that hold the same paths, or none, are equal.
        _local.scopes.pop()
        for path in paths:
            delete_path(spark, path)
