"""Keep derived columns from being evaluated again inside pushed-down filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def evaluate_once(df: DataFrame, names: list[str]) -> DataFrame:
    """Same rows; filters on ``names`` stay above the projection that derives them.

    Pushing a filter through a projection replaces every column by its
    expression. For chains of derived columns the copies multiply, and whole
    formulas run several times per row. A one-element ``inline`` stops that for
    the named columns only: filters on others, partition filters among them,
    still move down to the scan, and unused columns are still pruned.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(df.columns)
