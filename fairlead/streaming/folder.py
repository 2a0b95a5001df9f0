"""A folder of report files as a stream that also offers files changed in place.

What was offered is known by path, length and time of change. Each trigger lists
the folder and offers every file whose length or time differs from what was
offered last, by name. Every offer is one entry of a log beside the stream's
checkpoint, written before the batch runs; the stream's offset is the number of
the newest entry. So a restarted stream repeats the batch it was in, and offers
no file twice that did not change. From time to time the log is replaced by one
entry with the files that are still there.

Tasks stream the files and return digests; a file that cannot be read has an error
instead. Empty files and names starting with a dot or underscore are passed over.
A file that is listed while it is being written is offered again when it is done;
writers that move finished files into place spare that.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fairlead.sources.files import DIGESTS, digest_of
from fairlead.sources.paths import can_open, locate, qualified

#: Entries after which the log is put together.
COMPACT_AFTER = 32
#: Tasks of a batch; more files share them.
MOST_TASKS = 1024

#: path -> (length, nanoseconds of the last change)
Seen = dict[str, tuple[int, int]]


class OfferLog:
    """Numbered entries of offered files in one folder: ``<n>.json``, and ``<n>.all`` for everything up to n."""

    def __init__(self, path: str):
        self.store, self.place = locate(path)
        self.store.create_dir(self.place, recursive=True)

    def _names(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {"json": [], "all": []}
        for info in self.store.get_file_info(fs.FileSelector(self.place)):
            number, _, kind = info.base_name.partition(".")
            if kind in found and number.isdigit():
                found[kind].append(int(number))
        return found

    def read(self, number: int, kind: str = "json") -> Seen:
        with self.store.open_input_stream(f"{self.place}/{number}.{kind}") as source:
            return {path: tuple(state) for path, state in json.loads(source.read()).items()}

    def write(self, number: int, files: Seen, kind: str = "json") -> None:
        # Under another name first, so that a half-written entry is never read.
        hidden = f"{self.place}/.{number}.{kind}"
        with self.store.open_output_stream(hidden) as sink:
            sink.write(json.dumps(files).encode())
        self.store.move(hidden, f"{self.place}/{number}.{kind}")

    def load(self) -> tuple[int, Seen]:
        """Number of the newest entry, and what was offered up to it."""
        names = self._names()
        base = max(names["all"], default=0)
        seen = self.read(base, "all") if base else {}
        later = sorted(n for n in names["json"] if n > base)
        for number in later:
            seen |= self.read(number)
        return (later or [base])[-1], seen

    def compact(self, number: int, seen: Seen) -> None:
        """One entry instead of all up to ``number``."""
        names = self._names()
        if number - max(names["all"], default=0) < COMPACT_AFTER:
            return
        self.write(number, seen, "all")
        for kind, numbers in names.items():
            for old in numbers:
                if old < number:
                    self.store.delete_file(f"{self.place}/{old}.{kind}")


@dataclass
class FilesPartition(InputPartition):
    files: list[tuple[str, int, int]]


class FolderReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, log: str):
        self.folder, self.pattern = folder, pattern
        self.log = OfferLog(log)
        self.last, self.seen = self.log.load()

    def _listed(self) -> Seen:
        store, place = locate(self.folder)
        found = {}
        for info in store.get_file_info(fs.FileSelector(place)):
            name = info.base_name
            if info.is_file and info.size and name[0] not in "._" and fnmatch.fnmatchcase(name, self.pattern):
                found[f"{self.folder}/{name}"] = (info.size, info.mtime_ns)
        return found

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        listed = self._listed()
        changed = {path: state for path, state in sorted(listed.items()) if self.seen.get(path) != state}
        # What is gone may come back as something new.
        self.seen = {path: state for path, state in self.seen.items() if path in listed}
        if changed:
            self.log.write(self.last + 1, changed)
            self.last += 1
            self.seen |= changed
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        offered: Seen = {}
        for number in range(start["entry"] + 1, end["entry"] + 1):
            offered |= self.log.read(number)
        files = [(path, *state) for path, state in offered.items()]
        parts = min(len(files), MOST_TASKS)
        return [FilesPartition(files[i::parts]) for i in range(parts)] or [FilesPartition([])]

    def commit(self, end: dict) -> None:
        if end["entry"] == self.last:
            self.log.compact(self.last, self.seen)

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        for path, length, changed in partition.files:
            when = datetime.fromtimestamp(changed / 1e9, timezone.utc)
            yield (path, path.rsplit("/", 1)[-1], length, when, *digest_of(path))


class FolderSource(DataSource):
    """Options: path, pattern (default *.csv), log (a folder of the stream's own)."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return DIGESTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(self.options["path"], self.options.get("pattern", "*.csv"), self.options["log"])


def changed_files(spark: SparkSession, directory: str, log: str, pattern: str = "*.csv") -> DataFrame:
    """Digests of new and changed files of a folder, as a stream; ``log`` belongs with its checkpoint."""
    folder, log = qualified(spark, directory), qualified(spark, log)
    if not (can_open(folder) and can_open(log)):
        raise ValueError(f"{folder} or {log} can be opened by Spark's own file source only.")
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("report_files").options(path=folder, pattern=pattern, log=log).load()
