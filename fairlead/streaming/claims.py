"""Files that exactly one driver can create: leases on jobs and ranges of row numbers."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from fairlead.session import delete_path
from fairlead.sources.paths import parts, qualified, scheme_of
from fairlead.sources.tables import _children

#: Stores whose create fails on an existing name and shows a file only when it is complete.
_OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "abfs", "abfss")
#: Newest number ranges that are kept.
KEPT_RANGES = 64


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with this text unless it exists; of several drivers one gets True.

    The file is never seen without its text: a hard link on a local disk, a
    rename that does not replace on HDFS, a conditional create on object stores
    (``s3a`` needs a store that supports it).
    """
    path = qualified(spark, path)
    folder, _, name = path.rpartition("/")
    if scheme_of(path) == "file":
        place = parts(folder)[1]
        os.makedirs(place, exist_ok=True)
        draft = f"{place}/.{name}-{uuid.uuid4().hex}"
        with open(draft, "w") as out:
            out.write(text)
        try:
            os.link(draft, f"{place}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    direct = scheme_of(path) in _OBJECT_STORES
    draft = hadoop(path if direct else f"{folder}/.{name}-{uuid.uuid4().hex}")
    try:
        out = store.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
    except Exception as error:
        if direct and "FileAlreadyExists" in str(error):
            return False
        raise
    if direct or store.rename(draft, hadoop(path)):
        return True
    store.delete(draft, False)
    return False


def _text(spark: SparkSession, path: str) -> str | None:
    """The text of a published file, None if it is gone."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = location.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        source = store.open(location)
    except Exception as error:
        if "FileNotFound" in str(error) or "No such file" in str(error):
            return None
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


@dataclass(frozen=True)
class Leases:
    """Who works on which key. A lease ends by ``release`` or after ``seconds``; its owner may take it again.

    Leases of a key are numbered, and taking over an expired one creates the next
    number, so two drivers cannot both take it over.
    """

    spark: SparkSession
    path: str
    owner: str
    seconds: float

    def _newest(self) -> dict[str, int]:
        newest: dict[str, int] = {}
        for name in _children(self.spark, self.path):
            key, _, number = name.rpartition("-")
            if key and not name.startswith("."):
                newest[key] = max(int(number), newest.get(key, 0))
        return newest

    def _taken(self, key: str, number: int) -> bool:
        text = _text(self.spark, f"{self.path}/{key}-{number}")
        if text is None:
            return False
        owner, _, since = text.rpartition(" ")
        return owner != self.owner and time.time() < float(since) + self.seconds

    def of_others(self) -> list[str]:
        """Keys that others hold: those of one batch for each driver at work."""
        return [key for key, number in self._newest().items() if self._taken(key, number)]

    def take(self, keys: Iterable[str]) -> list[str]:
        """The keys that are this owner's now."""
        newest, mine = self._newest(), []
        for key in keys:
            number = newest.get(key, 0)
            if number and self._taken(key, number):
                continue
            if publish(self.spark, f"{self.path}/{key}-{number + 1}", f"{self.owner} {time.time()}"):
                mine.append(key)
        return mine

    def release(self, keys: Iterable[str]) -> None:
        """Give up the owner's leases of these keys; an expired one taken over by another stays."""
        newest = self._newest()
        for key in keys:
            number = newest.get(key, 0)
            path = f"{self.path}/{key}-{number}"
            text = _text(self.spark, path) if number else None
            if text is not None and text.rpartition(" ")[0] == self.owner:
                delete_path(self.spark, path)


def next_range(spark: SparkSession, path: str, n: int, at_least: int) -> int:
    """First of ``n`` consecutive numbers that no other call gets; numbering starts at ``at_least``.

    Each range is a numbered file that holds its end. A range made on an outdated
    listing is given up, which leaves a gap.
    """
    while True:
        names = sorted(int(name) for name in _children(spark, path) if name.isdigit())
        last = names[-1] if names else 0
        end = _text(spark, f"{path}/{last}") if last else "0"
        if end is None:
            continue
        first = max(int(end), at_least)
        if not publish(spark, f"{path}/{last + 1}", str(first + n)):
            continue
        if max(int(name) for name in _children(spark, path) if name.isdigit()) > last + 1:
            continue
        for old in names[:-KEPT_RANGES]:
            delete_path(spark, f"{path}/{old}")
        return first
