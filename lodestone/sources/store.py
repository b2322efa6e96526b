"""A versioned Parquet store of index tables.

Per-file tables lie in buckets by file id. A write makes a new version directory of the
buckets that changed, and of them alone; a small numbered pointer file then names the version in which each
bucket of each table is. Readers never see half a version, and a failed write leaves the old one.
The last ``KEEP`` versions, and all that a bucket is still in, stay. Plain
Parquet has no MERGE: an upsert is an anti-join and a union within the buckets it meets.

Document frequencies are kept as signed deltas: each write adds the terms of the files it
puts in and takes off those of the files it replaces, and a term's frequency is the sum. Weights are
those of the deltas that a refresh has counted, and of the number of files at that time; deltas beyond ``FOLD`` are
summed into one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.schema import DDL, SCHEMA_VERSION, Index, schema

#: Versions and pointers before the newest that are kept.
KEEP = 3
#: Buckets of the per-file tables, and deltas of document frequencies before they are summed.
BUCKETS = 16
FOLD = 24

FREQUENCY = "term STRING, n LONG"
PER_FILE = ("files", "symbols", "imports", "exports", "calls", "refs", "tfidf", "contents", "grams")


def last_wins(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Of rows with one key the last by ``order``."""
    w = W.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "path") -> DataFrame:
    """``new`` and those rows of ``old`` whose key it doesn't have."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_files(table: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Rows of a per-file table whose file is not among ``file_ids``."""
    return table.join(file_ids.select("file_id").distinct(), "file_id", "left_anti")


def invalidated(files: DataFrame, path: str | None = None) -> DataFrame:
    """``files`` with an empty hash, so that the next run reads them: one path, or all."""
    return files.withColumn("hash", F.lit("") if path is None else F.when(F.col("path") == path, "").otherwise(F.col("hash")))


class Store:
    """Index tables of one project below ``root`` (any path that Spark can write)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """Numbers of the pointer files, in order."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(self._path(""))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"CURRENT-(\d+)\.json", n)))

    def meta(self) -> dict:
        """The newest pointer file's content; empty if there is none."""
        found = self._pointers()
        if not found:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/CURRENT-{found[-1]}.json").collect()))

    def set_meta(self, **values) -> None:
        """Merge values into a new pointer file, written beside and then renamed.

        It has the next number, and the highest number counts, so there is a whole
        pointer at any time. Raises if another writer took the number.
        """
        fs, text, found = self._fs(), json.dumps({**self.meta(), **values}), self._pointers()
        fs.mkdirs(self._path(""))
        beside = self._path(f".next-{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(beside, self._path(f"CURRENT-{(found or [0])[-1] + 1}.json")):
            raise RuntimeError("another writer changed the store")
        for n in found[:-KEEP]:
            fs.delete(self._path(f"CURRENT-{n}.json"), False)

    def _meta(self) -> dict:
        """The pointer's content, if it is of this schema."""
        meta = self.meta()
        return meta if meta.get("schema_version") == SCHEMA_VERSION else {}

    def bucket(self, file_id: str | Column = "file_id") -> Column:
        """The bucket of a file's rows."""
        return F.pmod(F.col(file_id) if isinstance(file_id, str) else file_id, F.lit(self._meta().get("buckets", self.buckets))).cast("int")

    def _paths(self, at: dict[str, dict[str, str]], table: str, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = None if buckets is None else {str(b) for b in buckets}
        return [f"{self.root}/{v}/{table}" + (f"/bucket={b}" if b else "") for b, v in sorted(at.get(table, {}).items()) if wanted is None or b in wanted]

    def read(self, buckets: Iterable[int] | None = None) -> Index:
        """The current version, or its rows in some buckets; an empty index if there is none or its schema differs."""
        meta = self._meta()
        if not meta:
            return Index.empty(self.spark)
        at, empty = meta["at"], Index.empty(self.spark)
        tables = {}
        for t in DDL:
            paths = self._paths(at, t, buckets if t in PER_FILE else None)
            tables[t] = self.spark.read.schema(schema(t)).parquet(*paths) if paths else getattr(empty, t)
        tables["idf"] = self.inverse_frequencies()
        return Index(**tables)

    def frequencies(self, pending: bool = False) -> DataFrame:
        """``(term, n)``: the files that hold each term, by the deltas counted so far, or by all."""
        meta = self._meta()
        versions = meta.get("counted", []) + (meta.get("pending", []) if pending else [])
        if not versions:
            return self.spark.createDataFrame([], FREQUENCY)
        deltas = self.spark.read.schema(FREQUENCY).parquet(*[f"{self.root}/{v}/frequency" for v in versions])
        return deltas.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")

    def inverse_frequencies(self) -> DataFrame:
        """``(term, idf)`` as of the last refresh."""
        return self.frequencies().select("term", F.log(F.lit(float(self._meta().get("weighed_files", 0))) / F.col("n")).alias("idf"))

    def write(self, index: Index, tables: Iterable[str] = tuple(DDL), buckets: Iterable[int] | None = None, deltas: DataFrame | None = None, refresh: bool = True) -> str:
        """Write the named tables as a new version and point to it; the others stay where they are.

        With ``buckets``, ``index`` holds the rows of these alone, and of per-file
        tables only they are written. ``deltas(term, n)`` are the changes of document frequencies; without any,
        a write of "tfidf" counts all its terms anew. ``refresh`` lets the weights follow; else they stay as they are.
        """
        meta, version = self._meta(), f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        at = {t: dict(v) for t, v in meta.get("at", {}).items()}
        named = [t for t in dict.fromkeys((*tables, *(t for t in DDL if t not in at))) if t != "idf"]
        sort = {"files": "path", "symbols": "name", "calls": "callee_name", "tfidf": "term", "refs": "name", "grams": "gram"}
        for table in named:
            df = getattr(index, table).select(*schema(table).fieldNames())
            if table not in PER_FILE:
                df.write.parquet(f"{self.root}/{version}/{table}")
                at[table] = {"": version}
                continue
            told = df.withColumn("bucket", self.bucket())
            if buckets is not None:
                told = told.where(F.col("bucket").isin(sorted(buckets)))
            # Sorted files let readers skip row groups by min and max.
            order = ["bucket", sort[table]] if table in sort else ["bucket"]
            told.repartition("bucket").sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.root}/{version}/{table}")
            found = {f.getPath().getName().removeprefix("bucket=") for f in self._fs().listStatus(self._path(f"{version}/{table}")) if f.isDirectory()}
            kept = {} if buckets is None else {b: v for b, v in at.get(table, {}).items() if int(b) not in set(buckets)}
            at[table] = {**kept, **dict.fromkeys(found, version)}
        changes = {"schema_version": SCHEMA_VERSION, "version": version, "at": at, "buckets": meta.get("buckets", self.buckets), "older": [*meta.get("older", []), version]}
        changes |= self._counted(version, index, meta, deltas, recount=deltas is None and buckets is None and "tfidf" in named)
        if refresh and ("idf" in tables or deltas is not None or "tfidf" in named):
            changes["counted"], changes["pending"] = changes["counted"] + changes["pending"], []
            paths = self._paths(at, "files")
            changes["weighed_files"] = self.spark.read.schema(schema("files")).parquet(*paths).count() if paths else 0  # of the files' footers
        self.set_meta(**changes)
        if len(changes["counted"]) > FOLD:
            self._fold()
        self._clean()
        return version

    def _counted(self, version: str, index: Index, meta: dict, deltas: DataFrame | None, recount: bool) -> dict[str, list[str]]:
        """The versions whose deltas are counted and are pending, with this one's written."""
        counted, pending = list(meta.get("counted", [])), list(meta.get("pending", []))
        if recount:
            deltas, counted, pending = index.tfidf.groupBy("term").agg(F.count("*").alias("n")), [], []
        if deltas is not None:
            deltas.write.parquet(f"{self.root}/{version}/frequency")
            pending.append(version)
        return {"counted": counted, "pending": pending}

    def _fold(self) -> None:
        """Sum the counted deltas into one."""
        version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        self.frequencies().write.parquet(f"{self.root}/{version}/frequency")
        self.set_meta(counted=[version], older=[*self._meta()["older"], version])

    def _clean(self) -> None:
        """Delete versions in which no bucket and no delta of the current pointer is, but for the ``KEEP`` newest."""
        meta = self._meta()
        used = {v for t in meta["at"].values() for v in t.values()} | {*meta["counted"], *meta["pending"]}
        gone = [v for v in meta["older"][:-KEEP] if v not in used]
        for version in gone:
            self._fs().delete(self._path(version), True)
        if gone:
            self.set_meta(older=[v for v in meta["older"] if v not in gone])

    def start_session(self, now_ms: int) -> int:
        """Open a session and return its id."""
        index = self.read()
        last = index.sessions.agg(F.max("session_id")).first()[0] or 0
        row = self.spark.createDataFrame([(last + 1, now_ms, None, None)], schema("sessions"))
        index.sessions = index.sessions.unionByName(row)
        self.write(index, ["sessions"])
        return last + 1

    def end_session(self, session_id: int, now_ms: int) -> None:
        """Close a session with a snapshot of the current files."""
        from lodestone.operators.changes import current_state, snapshot_json

        index = self.read()
        text = snapshot_json(current_state(index.files, index.symbols)).first()[0] or "{}"
        mine = F.col("session_id") == session_id
        index.sessions = index.sessions.withColumn("ended_at", F.when(mine, F.lit(now_ms)).otherwise(F.col("ended_at"))).withColumn("file_snapshot", F.when(mine, F.lit(text)).otherwise(F.col("file_snapshot")))
        self.write(index, ["sessions"])
