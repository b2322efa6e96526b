"""A source tree as a partitioned data source, for listings and for event streams.

An entry belongs to the partition that the hash of its first ``KEY_DEPTH`` path parts names, so
a partition enters only its own folders below that depth, the same ones in every listing.
Each task walks its share; no listing passes through the driver. Dot entries and ignored folders are
not entered. The tree has to be at the same path on all executors.

``spark.read.format("tree")`` gives ``(path, mtime, length)``. ``spark.readStream.format("tree")`` gives events
``(path, event, ts, seq)``: each trigger lists the tree, and each task compares its share with
what it kept under ``state`` (a shared folder) at the trigger before. What a task listed for a
trigger stays there until the next one is done, so a trigger that is run again gives the same
events. A file counts as changed once it has not been written to for ``quiet_ms``. The first trigger adds every file.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.sources.config import IGNORED_DIRS

KEY_DEPTH = 2
PARTITIONS = 32
BATCH = 1 << 14
LISTED = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("length", pa.int64())])


def walked(root: str, part: int = 0, parts: int = 1) -> Iterator[tuple[str, int, int]]:
    """``(path, mtime in ms, length)`` of the files that belong to one of ``parts`` partitions."""
    own = lambda names: parts == 1 or zlib.crc32("/".join(names[:KEY_DEPTH]).encode("utf-8", "surrogateescape")) % parts == part
    left: list[tuple[str, ...]] = [()]
    while left:
        at = left.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, *at)), key=lambda e: e.name)
        except OSError:  # gone meanwhile, or not readable
            continue
        for entry in entries:
            if entry.name.startswith("."):
                continue
            names = (*at, entry.name)
            try:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in IGNORED_DIRS and (len(names) < KEY_DEPTH or own(names)):
                        left.append(names)
                elif own(names):
                    stat = entry.stat()
                    yield "/".join(names), stat.st_mtime_ns // 1_000_000, stat.st_size
            except OSError:
                continue


class Share(InputPartition):
    """One partition of a listing, between two triggers."""

    def __init__(self, part: int, start: int = 0, end: int = 0):
        self.part, self.start, self.end = part, start, end


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.parts = options["root"], int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[Share]:
        return [Share(k) for k in range(self.parts)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        for row in walked(self.root, partition.part, self.parts):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], schema=LISTED)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], schema=LISTED)


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["root"], options["state"]
        self.parts, self.quiet = int(options.get("partitions", PARTITIONS)), int(options.get("quiet_ms", "200"))

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(k, start["ms"], end["ms"]) for k in range(self.parts)]

    def _kept(self, share: Share, ms: int) -> str:
        return os.path.join(self.state, f"share-{share.part}-of-{self.parts}", f"{ms}.json")

    def _listing(self, share: Share, ms: int) -> dict[str, int]:
        if ms == 0:
            return {}
        with open(self._kept(share, ms)) as file:
            return json.load(file)

    def read(self, partition: Share) -> Iterator[tuple]:
        old, at = self._listing(partition, partition.start), self._kept(partition, partition.end)
        if not os.path.exists(at):
            now = {p: m for p, m, _ in walked(self.root, partition.part, self.parts)}
            young = partition.end - self.quiet
            for path in [p for p, m in now.items() if m > young and old.get(p) != m]:
                if path in old:
                    now[path] = old[path]  # still being written
                else:
                    del now[path]
            os.makedirs(os.path.dirname(at), exist_ok=True)
            beside = f"{at}.{uuid.uuid4().hex}"
            with open(beside, "w") as file:
                json.dump(now, file)
            os.replace(beside, at)
            for name in os.listdir(os.path.dirname(at)):
                if name.endswith(".json") and int(name.removesuffix(".json")) < partition.start:
                    os.remove(os.path.join(os.path.dirname(at), name))
        new = self._listing(partition, partition.end)
        told = [(p, "add" if p not in old else "unlink" if p not in new else "change") for p in sorted({*old, *new}) if old.get(p) != new.get(p)]
        when = datetime.fromtimestamp(partition.end / 1000)
        return iter([(p, e, when, (partition.end << 20) + i) for i, (p, e) in enumerate(told)])

    def commit(self, end: dict) -> None:
        """Nothing: a task removes what its share no longer needs."""


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, event string, ts timestamp, seq long" if "state" in self.options else "path string, mtime long, length long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


def listing(spark: SparkSession, root: str, partitions: int = PARTITIONS) -> DataFrame:
    """``(path, mtime, length)`` of all files of the tree."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("root", os.path.abspath(root)).option("partitions", str(partitions)).load()


def tree_events(spark: SparkSession, root: str, state: str, quiet_ms: int = 200, partitions: int = PARTITIONS) -> DataFrame:
    """The stream of events of the tree at ``root``."""
    spark.dataSource.register(TreeSource)
    reader = spark.readStream.format("tree").option("root", os.path.abspath(root)).option("state", state)
    return reader.option("quiet_ms", str(quiet_ms)).option("partitions", str(partitions)).load()
