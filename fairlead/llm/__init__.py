"""Operators of a training-data pipeline over text tables; each registers its query."""

from fairlead.llm import decontaminate, fingerprint, jaccard, line_dedup, merkle, mixing, periodic, pieces, pii, quality, quotes, suffix, warc  # noqa: F401
from fairlead.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
