"""Shared pieces: word rules, scratch tables and small column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of the contracts: maximal runs without space, \t, \n, \v, \f, \r.
GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors.

    ``spark.checkpoint.dir`` names it on a cluster. Only a local master without
    that setting gets a folder of its own under /tmp.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = getattr(spark.sparkContext, "_lodestone_scratch", None)
        if root is None:
            folder = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = spark.sparkContext._lodestone_scratch = f"file://{folder}"
        return root
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Settings while a scratch table is written: its shuffle files go with it, and small partitions
#: are put together, so that a small table is few files.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


#: Names of bucketed scratch tables in the catalog, by path.
_named: dict[str, str] = {}

_turn = threading.Lock()
_writers: dict[int, int] = {}
_before: dict[int, dict[str, str | None]] = {}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """``WRITING`` holds while a session writes: the first of several writers sets it, the last one puts back what was there."""
    own = id(spark)
    with _turn:
        if not _writers.get(own):
            _before[own] = {k: spark.conf.get(k, None) for k in WRITING}
            for k, v in WRITING.items():
                spark.conf.set(k, v)
        _writers[own] = _writers.get(own, 0) + 1
    try:
        yield
    finally:
        with _turn:
            _writers[own] -= 1
            if not _writers[own]:
                del _writers[own]
                for k, v in _before.pop(own).items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(df: DataFrame, label: str, by: str | None = None, turns: int = 1) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The shuffle files of the write go with it. ``by`` names a column to bucket the
    table by, so that later joins on it move only their other side. Such a table may be written in
    several ``turns``, some of its buckets in each, so that only a share of its shuffle files lies on disk at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _writing(spark):
        if by is None:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path), path
        name = _named[path] = f"lodestone_{path.rsplit('-', 1)[1]}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for turn in range(turns):
            # A row's bucket is told by Spark's hash.
            some = df if turns == 1 else df.where(F.pmod(F.pmod(F.hash(by), F.lit(buckets)), F.lit(turns)) == turn)
            write = some.write.option("compression", "zstd").mode("append" if turn else "errorifexists")
            write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(name)
        return spark.table(name), path


def _folder(spark: SparkSession, path: str):
    """A folder's file system and its path there, in Hadoop's terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def make_folder(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.mkdirs(where)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads, and its name if it was bucketed."""
    if (name := _named.pop(path, None)) is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    files, where = _folder(spark, path)
    files.delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once results are stored."""
    for path in list(_named):
        drop(spark, path)
    drop(spark, f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
