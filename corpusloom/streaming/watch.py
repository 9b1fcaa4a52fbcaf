"""A watched directory as a stream of snapshots, and the work that follows from their differences.

The built-in file source sees each path once and misses edits and deletions; this source lists the tree at each
trigger and emits a row for each path whose signature differs from the listing before, or that is gone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.paths import EXCLUDED_DIRS, EXCLUDED_FILES, EXCLUDED_SUFFIXES, MAX_FILE_BYTES
from ..operators.queueing import HIGH


def listing(root: str) -> dict[str, str]:
    """Path below ``root`` to signature (time of change and size), of what a scan takes: excluded names, directories among them, and files
    that are too large are left out, links not followed."""
    found = {}
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS and not d.endswith(tuple(EXCLUDED_SUFFIXES)))
        for name in files:
            path = os.path.join(folder, name)
            try:
                s = os.stat(path)
            except OSError:
                continue
            if name not in EXCLUDED_FILES and name not in EXCLUDED_DIRS and not name.endswith(tuple(EXCLUDED_SUFFIXES)) and s.st_size <= MAX_FILE_BYTES:
                found[os.path.relpath(path, root)] = f"{s.st_mtime_ns}:{s.st_size}"
    return found


class WatchReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def initialOffset(self) -> dict:
        return {"n": 0, "seen": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen, now = json.loads(start["seen"]), listing(self.root)
        rows = [(p, False, HIGH, s) for p, s in now.items() if seen.get(p) != s] + [(p, True, HIGH, None) for p in seen if p not in now]
        changed = bool(rows)
        return iter(rows), {"n": start["n"] + changed, "seen": json.dumps(now) if changed else start["seen"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Again what lay between two listings, after a failure."""
        seen, now = json.loads(start["seen"]), json.loads(end["seen"])
        return iter([(p, False, HIGH, s) for p, s in now.items() if seen.get(p) != s] + [(p, True, HIGH, None) for p in seen if p not in now])


class WatchSource(DataSource):
    """``spark.readStream.format("watched_tree").load(path)``: (path, delete, priority, signature)."""

    @classmethod
    def name(cls) -> str:
        return "watched_tree"

    def schema(self) -> str:
        return "path string, delete boolean, priority int, signature string"

    def simpleStreamReader(self, schema) -> WatchReader:
        return WatchReader(self.options)


def watch(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds"):
    """Start a query that hands the changes of each listing to ``handle(changes, batch)``; without ``every`` it stops when all is handled."""
    spark.dataSource.register(WatchSource)
    changes = spark.readStream.format("watched_tree").option("path", root).load()
    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
