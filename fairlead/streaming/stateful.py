"""Motion features on an unbounded report stream, in event-time order.

An option beside ``foreachBatch`` analytics. Reports wait until the watermark has
passed their time slice; then the slice is sorted and every report is linked to
the one before it, whichever order they came in. Reports within the lateness bound
therefore get what a batch run over all of them would give; later ones are dropped
by the engine, and reports without a time are left out.

Vessels are dealt to a fixed number of buckets by hash, and state is kept per bucket:
the waiting reports by (slice, part) as Arrow data, one part per chunk that came in,
and the last report of each vessel that was released. So calls to the state store
follow buckets and slices, not vessels. What a task holds in memory is one chunk on
the way in and one slice of one bucket on the way out, not a vessel's reports; a
vessel's slices are linked through the last report alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fairlead.operators import motion

SLICE_SECONDS = 3600
LATENESS = "1 hour"
#: Groups of vessels with state in common; a running stream keeps its number.
BUCKETS = 1024
_FIELDS = ["timestamp", "latitude", "longitude", "sog", "cog", "heading"]
_MEASURES = ", ".join(f"{c} double" for c in _FIELDS[1:])
_STATE = f"timestamp timestamp, {_MEASURES}"
_PREVIOUS = [f"prev_{c}" for c in _FIELDS]
_LINKED = f"id bigint, mmsi string, {_STATE}, linked boolean, " + ", ".join(
    f"prev_{part}" for part in _STATE.split(", ")
)
_COLUMNS = [part.split()[0] for part in _LINKED.split(", ")]


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class OrderedReports(StatefulProcessor):
    """Links every report of a bucket's vessels to the one before it once its slice is complete."""

    def __init__(self, slice_seconds: int) -> None:
        self._length = slice_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getMapState("rows", "slice bigint, part int", "data binary")
        self._parts = handle.getMapState("parts", "slice bigint", "n int")
        self._last = handle.getValueState("last", "data binary")
        self._alarm = handle.getValueState("alarm", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            # A row without an id only moves the watermark; one without a time has no place.
            chunk = chunk[chunk["id"].notna() & chunk["timestamp"].notna()]
            if key[0] is None:
                # Nothing comes before a report of no vessel.
                yield self._linked(chunk, None)
                continue
            number = chunk["timestamp"].astype("datetime64[ms]").astype("int64") // self._length
            for at, part in chunk.groupby(number):
                n = self._parts.getValue((int(at),))[0] if self._parts.containsKey((int(at),)) else 0
                self._rows.updateValue((int(at), n), (_packed(part[["id", "mmsi", *_FIELDS]]),))
                self._parts.updateValue((int(at),), (n + 1,))
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            self._wake((first + 1) * self._length)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._alarm.clear()
        watermark = timerValues.getCurrentWatermarkInMs()
        last = _unpacked(bytes(self._last.get()[0])) if self._last.exists() else None
        for at in sorted(k[0] for k in self._parts.keys()):
            if (at + 1) * self._length > watermark:
                self._wake((at + 1) * self._length)
                break
            parts = range(self._parts.getValue((at,))[0])
            rows = pd.concat([_unpacked(bytes(self._rows.getValue((at, n))[0])) for n in parts])
            rows = rows.sort_values(["mmsi", "timestamp", "id"], kind="stable", ignore_index=True)
            yield self._linked(rows, last)
            newest = rows[["mmsi", *_FIELDS]].drop_duplicates("mmsi", keep="last")
            last = newest if last is None else pd.concat([last, newest]).drop_duplicates("mmsi", keep="last")
            self._last.update((_packed(last),))
            self._parts.removeKey((at,))
            for n in parts:
                self._rows.removeKey((at, n))

    def _wake(self, at: int) -> None:
        """One timer per bucket, at the end of its earliest waiting slice."""
        if self._alarm.exists():
            if self._alarm.get()[0] <= at:
                return
            self._handle.deleteTimer(self._alarm.get()[0])
        self._handle.registerTimer(at)
        self._alarm.update((at,))

    def _linked(self, rows: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        """Rows in order of vessel and time with the row before each; a vessel's first one follows its row in ``before``."""
        if not len(rows) or rows["mmsi"].isna().any():
            previous, linked = rows[_FIELDS].iloc[:0].reindex(rows.index), rows["mmsi"].notna()
        else:
            previous = rows[_FIELDS].shift(1)
            begins = rows["mmsi"] != rows["mmsi"].shift(1)
            linked = ~begins
            if before is not None:
                own = before.set_index("mmsi")
                known = begins & rows["mmsi"].isin(own.index)
                earlier = own.loc[rows["mmsi"][known], _FIELDS].set_index(rows.index[known])
                previous = pd.concat([previous[~known], earlier]).sort_index()
                linked = linked | known
        previous.columns = _PREVIOUS
        return pd.concat([rows, previous], axis=1).assign(linked=linked)[_COLUMNS]

    def close(self) -> None:
        pass


def report_stream(spark: SparkSession, path: str, schema, bytes_per_trigger: int = 512 * 1024 * 1024) -> DataFrame:
    """Stored reports as a stream whose triggers take at most about this much."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)


def end_marker(spark: SparkSession, schema, at: datetime) -> DataFrame:
    """A row that belongs to no vessel and moves the watermark to ``at`` less the lateness.

    Written behind a finished recording it releases the reports that still wait.
    """
    return spark.createDataFrame([(at,)], "at timestamp").select(
        *[(F.col("at") if f.name == "timestamp" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def stateful_motion(
    reports: DataFrame, lateness: str = LATENESS, slice_seconds: int = SLICE_SECONDS, buckets: int = BUCKETS
) -> DataFrame:
    """Streaming features; the arithmetic is the batch operator's, in built-in expressions.

    A report is given out when the watermark (newest time seen less ``lateness``)
    has passed the end of its slice.
    """
    chosen = reports.select("id", "mmsi", *_FIELDS).withWatermark("timestamp", lateness)
    # Text: a missing number would reach pandas as NaN, and turn the others into fractions.
    bucket = F.when(F.col("mmsi").isNotNull(), F.pmod(F.xxhash64("mmsi"), F.lit(buckets)).cast("string"))
    linked = chosen.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=OrderedReports(slice_seconds), outputStructType=_LINKED, outputMode="Append", timeMode="EventTime"
    )
    previous = F.struct(*[F.col(p).alias(c) for p, c in zip(_PREVIOUS, _FIELDS)])
    linked = linked.withColumn("_prev", F.when(F.col("linked"), previous)).drop("linked", *_PREVIOUS)
    return motion.measure(linked).drop("_prev")
