"""File names as they come: opening them in tasks, and naming them to Spark's readers."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession

#: Schemes of Hadoop paths and the name Arrow has for the same store.
_ARROW_SCHEMES = {
    "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3",
    "gs": "gs", "abfs": "abfs", "abfss": "abfss",
}
_PATH = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)", re.S)


def scheme_of(path: str) -> str:
    return (_PATH.fullmatch(path).group(1) or "file").lower()


def can_open(path: str) -> bool:
    """Whether tasks can stream the file without Spark's readers."""
    return scheme_of(path) in _ARROW_SCHEMES


def parts(path: str) -> tuple[str, str]:
    """Store, as a URI for Arrow, and literal place inside it of a Hadoop path (no escapes, no query, no fragment)."""
    scheme, authority, place = _PATH.fullmatch(path).groups()
    scheme = (scheme or "file").lower()
    if scheme not in _ARROW_SCHEMES:
        raise ValueError(f"No way to open {scheme} paths outside Spark's readers.")
    # Only the store is a URI, so that no character of the name is read as a part of one.
    return f"{_ARROW_SCHEMES[scheme]}://{authority or ''}/", place


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place in it of a Hadoop path."""
    root, place = parts(path)
    if root.startswith("file:"):
        return fs.LocalFileSystem(), place
    store, base = fs.FileSystem.from_uri(root)
    # Object stores have the bucket in front, HDFS starts at its root.
    return store, f"{base.rstrip('/')}/{place.lstrip('/')}"


def literal(path: str) -> str:
    """The path for Spark's readers, which would take some characters for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark's listings show it."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(location).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)
