"""Named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fairlead.plans.warehouse import Warehouse
from fairlead.session import ensure_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a warehouse; without SQL only its rows are checked."""

    def add(build: Callable[[Warehouse], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_settings(spark)
            return tidy(build(Warehouse.open(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Types that hash alike in every engine: rounded doubles, micros, bigints, joined lists."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.floor(c.cast("double") * 1e6 + 0.5) / 1e6
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.concat_ws("|", c)
        columns.append(c.alias(field.name))
    return df.select(*columns)
