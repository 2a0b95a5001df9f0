"""Helpers shared by the corpus operators: tables, stored steps, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairlead.session import delete_path, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Shuffle files of a finished write are of no further use: its result is the written table.
_WHILE_STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register a query of the subpackage; without SQL it is tested by brute force."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what ``stored`` wrote inside, but for results stored with ``outer``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def stored(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The written table outlives lost executors, and the shuffle files that made
    it are given back at once instead of at some later garbage collection.
    ``outer`` keeps it beyond the present scope.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    owners = _scopes[: len(_scopes) - outer]
    if owners:
        owners[-1].append(path)
    before = {key: spark.conf.get(key) for key in _WHILE_STORING}
    try:
        for key, value in _WHILE_STORING.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def components(links: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): rows (node, component).

    ``component`` is the smallest node that can be reached. Alternates large
    and small stars until the edges stay as they are, so that a group never
    meets in one task and the rounds grow with the logarithm of its size. Every
    round is a stored table; minima are combined before they are shuffled.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    with scope(links.sparkSession):
        edges = stored(edges)
        state = None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = stored(large.filter("u <> v").distinct())
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
        roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
        members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return stored(members.unionByName(roots), outer=True)
