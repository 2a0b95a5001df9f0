"""Time filters that also select the date partitions of a stored table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.functions import coerce

DATE = "message_date"


def in_range(df: DataFrame, column: str, start: datetime | Column | None, end: datetime | Column | None) -> DataFrame:
    """Rows with ``column`` in the closed range; a missing bound is open.

    A table that still has its partition column is limited to the dates of the
    range as well, which skips whole folders.
    """
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        moment = bound if isinstance(bound, Column) else coerce.utc(bound)
        df = df.filter(F.col(column) >= moment if low else F.col(column) <= moment)
        if DATE in df.columns:
            day = F.to_date(moment)
            df = df.filter(F.col(DATE) >= day if low else F.col(DATE) <= day)
    return df
