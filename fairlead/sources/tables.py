"""Stored tables with keyed writes, as Parquet in the shared folder.

Messages only ever grow: new keys are appended. Alerts and assessments can be
replaced: only the date partitions a batch touches are rewritten. The vessel
table is small and is written anew as a version next to the last one.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.functions.dates import DATE
from fairlead.operators.linking import last_per_key, merge_vessels
from fairlead.session import cut_by, cut_lineage, delete_path

#: Age in seconds at which a replaced version may go; longer than any query that reads it.
KEEP_SECONDS = 24 * 3600.0
#: Bytes of staged rows from which their files are moved into the table; fewer are written again, as fewer files.
MOVE_BYTES = 128 << 20


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _children(spark: SparkSession, path: str) -> list[str]:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(location)] if system.exists(location) else []


def _age(spark: SparkSession, path: str) -> float:
    """Seconds since a folder's success marker was written."""
    location = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    status = location.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(location)
    return time.time() - status.getModificationTime() / 1000


def _move_partitions(spark: SparkSession, source: str, target: str, least: int) -> bool:
    """Move the files of a dated folder into the same dates of another, if they have that many bytes and can be moved."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    system = path(source).getFileSystem(conf)
    if system.getUri() != path(target).getFileSystem(conf).getUri() or system.getContentSummary(path(source)).getLength() < least:
        return False
    for part in _children(spark, source):
        if not part.startswith(f"{DATE}="):
            continue
        system.mkdirs(path(f"{target}/{part}"))
        for status in system.listStatus(path(f"{source}/{part}")):
            name = status.getPath().getName()
            if not system.rename(status.getPath(), path(f"{target}/{part}/{name}")):
                raise OSError(f"{source}/{part}/{name} cannot be moved to {target}.")
    return True


def days_of(dated: DataFrame) -> list:
    """Calendar days in a batch: one value per day, not per report."""
    return [r[0] for r in dated.select(DATE).distinct().collect()]


@dataclass(frozen=True)
class DatedTable:
    """Keyed table partitioned by the UTC date of ``time``."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    time: str = "timestamp"

    def read(self) -> DataFrame:
        """All rows, with the partition column so that filters can use it."""
        if not any(name.startswith(f"{DATE}=") for name in _children(self.spark, self.path)):
            return self.spark.createDataFrame([], f"{self.schema}, {DATE} date")
        return self.spark.read.schema(f"{self.schema}, {DATE} date").parquet(self.path)

    def _dated(self, df: DataFrame) -> DataFrame:
        names = [part.split()[0] for part in self.schema.split(", ")]
        return df.select(*names).withColumn(DATE, F.to_date(self.time))

    def _holds(self, days: list) -> bool:
        """Whether there are stored rows of any of these days, by the names of the partitions."""
        return bool({f"{DATE}={day}" for day in days} & set(_children(self.spark, self.path)))

    def _stored_on(self, batch: DataFrame) -> DataFrame:
        """Stored rows of the dates in the batch; other partitions are not read."""
        return self.read().filter(F.col(DATE).isin(days_of(batch)))

    def new_rows(self, source: DataFrame, order: str) -> DataFrame:
        """Rows of the source whose key is not stored yet, staged for appending.

        Equal keys inside the source count once, the first by ``order``. Further
        columns of the source (its file) stay on the rows.
        """
        first = last_per_key(source.withColumn("_order", -F.col(order).cast("bigint")), self.keys, "_order")
        # Stored before its dates are looked up, so the source is computed once.
        batch = cut_lineage(first.drop("_order").withColumn(DATE, F.to_date(self.time)))
        if not self._holds(days_of(batch)):
            return batch.drop(DATE)
        return cut_lineage(batch.join(self._stored_on(batch), [*self.keys, DATE], "left_anti").drop(DATE))

    def append(self, fresh: DataFrame) -> None:
        self._dated(fresh).write.mode("append").partitionBy(DATE).parquet(self.path)

    def insert_new(self, source: DataFrame, order: str, distinct: bool = False) -> tuple[int, int]:
        """Append what is new; (offered, inserted) counts. A repeat inserts nothing.

        Repeated and stored rows are looked for among the keys alone, repeated ones
        not at all if the caller knows that keys are ``distinct``. Rows are staged as
        the table keeps them: where all are new and many, their files are moved into
        it, so that they are on disk once. Whole rows are shuffled only where some of
        them, not all, must be left out.
        """
        names = [part.split()[0] for part in self.schema.split(", ")]
        further = [] if order in names else [order]
        offered, path = cut_by(source.select(*names, *further).withColumn(DATE, F.to_date(self.time)), DATE)
        asked = offered.count()
        repeated, known = self._met(offered, distinct)
        inserted = asked - known
        if repeated or known not in (0, asked):
            fresh = self.new_rows(offered, order)
            inserted = fresh.count()
            if inserted:
                self.append(fresh)
        elif inserted and (further or not _move_partitions(self.spark, path, self.path, MOVE_BYTES)):
            self.append(offered)
        delete_path(self.spark, path)
        return asked, inserted

    def _met(self, offered: DataFrame, distinct: bool) -> tuple[bool, int]:
        """Whether a key comes more than once, and how many rows have a key that is stored already."""
        keys = offered.select(*self.keys, DATE)
        repeated = False
        if not distinct:
            times = keys.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_times"))
            repeated = times.agg(F.count_if(F.col("_times") > 1)).first()[0] > 0
        days = days_of(keys)
        if not self._holds(days):
            return repeated, 0
        stored = self.read().filter(F.col(DATE).isin(days)).select(*self.keys, DATE)
        return repeated, keys.join(stored, [*self.keys, DATE], "left_semi").count()

    def exchange(self, gone: DataFrame, source: DataFrame, order: str) -> int:
        """Delete the rows that match ``gone`` (some of the keys, and the time column), then insert ``source``.

        The source's rows must be among those deleted, so that a repeat gives the
        same table. Rewrites the touched dates only.
        """
        gone = cut_lineage(gone.withColumn(DATE, F.to_date(self.time)))
        days = days_of(gone)
        if not days:
            return 0
        keys = [c for c in self.keys if c in gone.columns]
        batch = cut_lineage(last_per_key(self._dated(source), self.keys, order))
        stored = self.read().filter(F.col(DATE).isin(days))
        kept = stored.join(gone.select(*keys, DATE).distinct(), [*keys, DATE], "left_anti").select(*batch.columns)
        merged = cut_lineage(kept.unionByName(batch))
        full = set(days_of(merged))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(self.path)
        # A date that lost all its rows is not overwritten by the above.
        for day in set(days) - full:
            delete_path(self.spark, f"{self.path}/{DATE}={day}")
        return batch.count()

    def upsert(self, source: DataFrame, order: str) -> int:
        """Insert or replace by key; of equal keys in the batch the last by ``order`` stays.

        Rewrites the touched dates only. The merged partitions are complete on
        disk before they replace the old ones, and a repeat gives the same table.
        """
        batch = cut_lineage(last_per_key(self._dated(source), self.keys, order))
        written = batch.count()
        if not written:
            return 0
        merged = batch
        if self._holds(days_of(batch)):
            kept = self._stored_on(batch).join(batch, [*self.keys, DATE], "left_anti").select(*batch.columns)
            merged = cut_lineage(kept.unionByName(batch))
        (
            merged.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(DATE)
            .parquet(self.path)
        )
        return written


@dataclass(frozen=True)
class VersionedTable:
    """Small table written as a whole; readers see the newest finished version."""

    spark: SparkSession
    path: str
    schema: str
    keep_seconds: float = KEEP_SECONDS

    def _versions(self) -> list[int]:
        names = [n for n in _children(self.spark, self.path) if n.startswith("v=")]
        return sorted(int(n[2:]) for n in names if _exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={versions[-1]}")

    def replace(self, df: DataFrame) -> None:
        names = [part.split()[0] for part in self.schema.split(", ")]
        started = [int(n[2:]) for n in _children(self.spark, self.path) if n.startswith("v=")]
        df.select(*names).write.parquet(f"{self.path}/v={max(started, default=0) + 1}")
        # A version stays for queries that read it until its successor is old enough.
        versions = self._versions()
        for old, successor in zip(versions, versions[1:]):
            if _age(self.spark, f"{self.path}/v={successor}") >= self.keep_seconds:
                delete_path(self.spark, f"{self.path}/v={old}")

    def merge_vessels(self, incoming: DataFrame) -> None:
        """Take over new metadata and widen the seen interval."""
        self.replace(merge_vessels(self.read(), incoming))


# --- the same policies as pure DataFrame functions -------------------------------


def upsert_replace(target: DataFrame, source: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Target after INSERT ... ON CONFLICT DO UPDATE with the source."""
    last = last_per_key(source, keys, order)
    return target.join(last.select(*keys), list(keys), "left_anti").select(target.columns).unionByName(
        last.select(target.columns)
    )


def upsert_ignore(target: DataFrame, source: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Rows that INSERT ... ON CONFLICT DO NOTHING would add."""
    first = last_per_key(source.withColumn("_order", -F.col(order).cast("bigint")), keys, "_order").drop("_order")
    return first.join(target.select(*keys), list(keys), "left_anti").select(source.columns)
