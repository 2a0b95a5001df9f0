"""Import of alert and assessment files into the stored tables.

Each file is checked, linked to the stored messages and written by key; rows
that cannot be used are counted, not stored. Alerts that are stored already are
left as they are, assessments of the same version are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fairlead.operators import linking
from fairlead.session import cut_lineage, temporary_stages
from fairlead.sources.files import scan_raw_csv
from fairlead.streaming.store import Store

_COUNTERS = (
    "rows_read bigint, rows_rejected bigint, messages_not_found bigint, duplicates_skipped bigint, rows_imported bigint"
)


def _counters(store: Store, read: int, rejected: int, unmatched: int, imported: int) -> DataFrame:
    row = (read, rejected, unmatched, read - rejected - unmatched - imported, imported)
    return store.spark.createDataFrame([row], _COUNTERS)


def _linked(rows: DataFrame, good: DataFrame, bad: DataFrame, linked: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(rows with a message, rows read, rows rejected, rows without a message)."""
    found = cut_lineage(linking.matched(linked))
    total, rejected = rows.count(), bad.count()
    return found, total, rejected, total - rejected - found.count()


def import_alerts(store: Store, path: str | list[str]) -> DataFrame:
    """Alerts of CSV files; one row of counters. Repeating an import adds nothing."""
    with temporary_stages(store.spark):
        rows = cut_lineage(scan_raw_csv(store.spark, path))
        good, bad = linking.alert_validate(rows)
        found, read, rejected, unmatched = _linked(rows, good, bad, linking.link_alerts(good, store.messages.read()))
        _, inserted = store.alerts.insert_new(found, order="ord")
        return _counters(store, read, rejected, unmatched, inserted)


def import_risks(store: Store, path: str | list[str], version: str = linking.RISK_VERSION) -> DataFrame:
    """Assessments of CSV files as ``version``; one row of counters. Of equal messages the last row stays."""
    with temporary_stages(store.spark):
        rows = cut_lineage(scan_raw_csv(store.spark, path))
        good, bad = linking.risk_validate(rows)
        found, read, rejected, unmatched = _linked(rows, good, bad, linking.link_risk(good, store.messages.read()))
        last = linking.last_per_key(found, ("message_id",), "ord").withColumn("assessment_version", F.lit(version))
        written = store.risks.upsert(last, order="message_id")
        return _counters(store, read, rejected, unmatched, written)
