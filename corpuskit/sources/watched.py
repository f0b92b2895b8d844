"""Changes of the files below a folder as a streaming source."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpuskit.functions import constants as K

SCHEMA = "ts timestamp, seq long, event_type string, path string, dest_path string"
#: Tasks of one look at the folders.
BUCKETS = 32


@dataclass
class _Folders(InputPartition):
    """The folders of one bucket, and between which two looks."""

    bucket: int
    folders: list[str]
    start: int
    end: int


class WatchedFilesReader(DataSourceStreamReader):
    """Offsets are the times of looks. A look's listings lie in the snapshot folder, one file a bucket of folders.

    The driver walks the folders alone; tasks list their files, compare them
    with the snapshot of the look before, and write that of their own, unless a
    task that failed later has written it: then that one counts, so a batch that
    comes again holds the same events.
    """

    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.snapshots = options["snapshots"].removeprefix("file://")
        self.interval = float(options.get("interval", "1"))
        self.buckets = int(options.get("buckets", BUCKETS))
        self.last = 0

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self) -> dict:
        now = time.time_ns() // 1000
        if now - self.last >= self.interval * 1_000_000:
            self.last = now
        return {"look": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Folders]:
        there: list[list[str]] = [[] for _ in range(self.buckets)]
        for folder, below, _ in os.walk(self.root):
            below[:] = [d for d in below if d not in K.EXCLUDED_DIRS]
            there[int(hashlib.md5(folder.encode()).hexdigest(), 16) % self.buckets].append(folder)
        return [_Folders(i, folders, start["look"], end["look"]) for i, folders in enumerate(there)]

    def _file(self, bucket: int, look: int) -> str:
        return os.path.join(self.snapshots, f"{bucket:05d}", f"{look}.json")

    def _listing(self, folders: list[str]) -> dict[str, list[int]]:
        found = {}
        for folder in folders:
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.is_file() and os.path.splitext(e.name)[1].lower() in K.EXTENSIONS and not e.name.startswith(K.LOCK_PREFIX):
                            found[e.path] = [e.stat().st_mtime_ns, e.stat().st_size]
            except OSError:  # gone since the walk
                continue
        return found

    def _snapshot(self, part: _Folders) -> dict[str, list[int]]:
        name = self._file(part.bucket, part.end)
        if not os.path.exists(name):
            os.makedirs(os.path.dirname(name), exist_ok=True)
            own = f"{name}.{os.getpid()}.{time.time_ns()}"
            with open(own, "w") as f:
                json.dump(self._listing(part.folders), f)
            os.replace(own, name)
        with open(name) as f:
            return json.load(f)

    def read(self, partition: _Folders) -> Iterator[tuple]:
        import datetime as dt

        before: dict[str, list[int]] = {}
        if os.path.exists(self._file(partition.bucket, partition.start)):
            with open(self._file(partition.bucket, partition.start)) as f:
                before = json.load(f)
        after = self._snapshot(partition)
        at = dt.datetime.fromtimestamp(partition.end / 1_000_000, dt.timezone.utc)
        rows = [("deleted", p) for p in before.keys() - after.keys()] + [("created", p) for p in after.keys() - before.keys()]
        rows += [("modified", p) for p in after.keys() & before.keys() if after[p] != before[p]]
        for i, (kind, path) in enumerate(sorted(rows)):
            yield at, i, kind, path, None

    def commit(self, end: dict) -> None:
        """Snapshots before a finished look are not needed any more."""
        for name in glob.glob(os.path.join(glob.escape(self.snapshots), "*", "*.json")):
            if int(os.path.basename(name).split(".")[0]) < end["look"]:
                os.unlink(name)


class WatchedFiles(DataSource):
    """``spark.readStream.format("watched_files")``: created, modified and deleted files of known kinds below ``path``.

    Options: ``path``, the folder; ``snapshots``, a folder that driver and
    executors share, kept with the query's checkpoint; ``interval``, seconds
    between looks; ``buckets``, tasks of a look. The first look gives every file
    as created; a query that starts again on its checkpoint goes on from its last
    look, so what changed meanwhile comes out then. A file is modified when its
    time or size is another one. A rename is a delete and a create. Excluded
    folders, other kinds of files and lock files are left out; ``ts`` is the time
    of the look, which the order of looks follows.
    """

    @classmethod
    def name(cls) -> str:
        return "watched_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> WatchedFilesReader:
        return WatchedFilesReader(dict(self.options))


def watch_files(spark: SparkSession, root: str, snapshots: str, interval: float = 1.0, buckets: int = BUCKETS):
    """The stream of file events below a folder, for ``route_events``, ``quiet_bursts`` and ``IndexStore.follow``."""
    spark.dataSource.register(WatchedFiles)
    return spark.readStream.format("watched_files").option("path", root).option("snapshots", snapshots).option("interval", str(interval)).option("buckets", str(buckets)).load()
