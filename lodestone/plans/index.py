"""Building and refreshing an index: files to tables.

Listing, filters and the incremental comparison are DataFrames; each changed
file is read and parsed once, in one Arrow function, whose nested result is then
exploded into the tables. Per-file rows are replaced by anti-join and union in the buckets
of the store that hold a changed file.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.extract import extract
from lodestone.functions.text import content_hash, language, line_count
from lodestone.operators.search import inverse_frequencies, term_frequencies
from lodestone.operators.trigrams import postings
from lodestone.plans.incremental import content_status, file_status
from lodestone.plans.resolve import resolved
from lodestone.schema import EXTRACTED, Index, schema
from lodestone.sources import config as conf
from lodestone.sources.scan import contents, selected
from lodestone.sources.store import PER_FILE, Store, invalidated, last_wins, without_files
from lodestone.sources.tree import listing

log = logging.getLogger(__name__)


def extracted(files: DataFrame) -> DataFrame:
    """``(path, lang, x, error)`` from ``(path, content)``: what each file's extractor found.

    A file on which its extractor fails has a null ``x`` and the error's text; the others go on.
    Files are dealt over tasks by number first: extraction takes far longer than their bytes tell, by which
    adaptive execution would put them in few.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(f"x {EXTRACTED}")["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    found.append(extract(lang, text or ""))
                    errors.append(None)
                except Exception as error:  # extractors may be plugged in: any failure is one file's own
                    found.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind), pa.array(errors, pa.string())], ["path", "lang", "x", "error"])

    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return files.select("path", language(F.col("path")).alias("lang"), "content").repartition(tasks, "path").mapInArrow(run, f"path string, lang string, x {EXTRACTED}, error string")


def file_id(path="path"):
    return F.xxhash64(path)


def without_failed(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``read(path, content, ...)`` without the files on which extraction fails, these as ``(path, error)``, and what was found."""
    found = extracted(read).persist()
    failed = found.where("error is not null").select("path", "error")
    return read.join(failed, "path", "left_anti"), failed, found.where("error is null").drop("error")


def tables_of(read: DataFrame, found: DataFrame, whole: DataFrame, aliases: tuple = (None, []), module: str | None = None, now_ms: int = 0) -> Index:
    """Index tables of the files ``read(path, content, mtime, hash)`` and of what was ``found`` in them; ``whole`` lists the tree for imports."""
    files = read.select(file_id().alias("file_id"), "path", "hash", "mtime", line_count(F.col("content")).alias("lines"), F.lit(now_ms).cast("long").alias("indexed_at"))
    rows = lambda part: found.select("path", "lang", F.posexplode(f"x.{part}").alias("seq", "r")).select("path", "lang", "seq", "r.*")
    key = ["path", "name", "kind", "start_line"]
    symbols = last_wins(rows("symbols"), key).select(F.xxhash64(*key).alias("symbol_id"), file_id().alias("file_id"), "name", "kind", "start_line", "end_line", "is_exported", "signature", "doc", "seq")
    at = resolved(rows("imports"), whole, aliases, module)
    imports = at.select(F.xxhash64("path", F.lit("i"), "seq").alias("import_id"), file_id().alias("file_id"), "symbol", "from_path", "is_type_only", "is_external", "seq")
    out = rows("exports")
    passed = resolved(out.where("is_reexport"), whole, aliases, module).withColumn("original_path", F.col("from_path")).select("path", "seq", "original_path")
    exports = out.join(passed, ["path", "seq"], "left").select(F.xxhash64("path", F.lit("e"), "seq").alias("export_id"), file_id().alias("file_id"), "symbol", "kind", "is_reexport", "original_path", "seq")
    first = symbols.groupBy("file_id", "name").agg(F.min_by("symbol_id", "seq").alias("caller_symbol_id")).withColumnRenamed("name", "parent_symbol")
    calls = rows("calls").withColumn("file_id", file_id()).join(first, ["file_id", "parent_symbol"]).select(F.xxhash64("path", F.lit("c"), "seq").alias("call_id"), "caller_symbol_id", "callee_name", "file_id", "line", "seq")
    refs = found.select(file_id().alias("file_id"), F.explode("x.refs").alias("name")).dropDuplicates(["file_id", "name"])
    kept = read.select(file_id().alias("file_id"), "content")
    tf = term_frequencies(kept)
    grams = postings(symbols, "symbol").unionByName(postings(calls.select(F.col("callee_name").alias("name"), "file_id"), "call"))
    spark = read.sparkSession
    return Index(files, symbols, imports, exports, calls, refs, tf, spark.createDataFrame([], schema("idf")), spark.createDataFrame([], schema("sessions")), kept, grams)


def with_idf(index: Index) -> Index:
    """The same index with term weights over all its files; none leaves the old ones."""
    n = index.files.count()
    if n:
        index.idf = inverse_frequencies(index.tfidf, n)
    return index


def frequency_changes(new: DataFrame, old: DataFrame, gone: DataFrame) -> DataFrame:
    """``(term, n)``: by how many files each term gains, from the term rows put in and those of the files in ``gone`` taken out."""
    added = new.select("term", F.lit(1).alias("n"))
    lost = old.join(gone.select("file_id").distinct(), "file_id", "left_semi").select("term", F.lit(-1).alias("n"))
    return added.unionByName(lost).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")


def index_project(spark: SparkSession, root: str, store: Store, now_ms: int = 0, config: conf.Config | None = None, paths: list[str] | DataFrame | None = None, refresh_idf: bool = True) -> dict[str, int]:
    """Bring the store up to date with the tree; returns counts of indexed, skipped, removed and failed files, and the time in ms.

    A file on which extraction fails keeps what is stored of it and is tried again by the next run. Only files whose time, then content, changed are parsed. Files that the
    configuration now leaves out are removed with those that are gone. ``paths`` (a list, or rows with a ``path``)
    limits the run to some files; ``refresh_idf=False`` leaves term weights as
    they are. Only buckets with a changed file are read and written, but for the table of files, which the listing is
    compared with. The counts are observed in the one pass that finds these buckets.
    """
    config, began = config or conf.load_config(root), time.monotonic()
    files, whole = store.read().files, listing(spark, root).persist()
    wanted = selected(whole, config)
    status = file_status(wanted, files, config.max_file_size)
    if isinstance(paths, DataFrame):
        status = status.join(paths.select("path").distinct(), "path", "left_semi")
    elif paths is not None:
        status = status.where(F.col("path").isin(paths))
    status = status.persist()
    due = status.where("status = 'read'").select("path")
    text = contents(root, due).join(whole.select("path", "mtime"), "path").withColumn("hash", content_hash(F.col("content")))
    told = content_status(text, files).persist()
    fresh, failed, found = without_failed(told.where("not touched").drop("touched"))
    gone = status.where("status = 'removed'").select("path")
    kinds = [(gone, "removed"), (told.where("touched"), "touched"), (failed, "failed"), (found, "indexed"), (status.where("status <> 'removed'"), "seen")]
    start = spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit("start").alias("kind"))  # Spark drops the metrics of a plan whose result is empty
    outcome = reduce(DataFrame.unionByName, [df.select("path", F.lit(kind).alias("kind")) for df, kind in kinds], start)
    run = Observation("index run")
    observed = outcome.observe(run, *[F.count(F.when(F.col("kind") == kind, 1)).alias(kind) for _, kind in kinds])
    bucket = F.when(F.col("kind").isin("removed", "touched", "indexed"), store.bucket(file_id()))
    buckets = sorted(r[0] for r in observed.select(bucket).distinct().collect() if r[0] is not None)
    counts = run.get
    if counts["failed"]:
        for r in failed.limit(100).collect():
            log.warning("error indexing %s: %s", r["path"], r["error"])
    if buckets:
        new = tables_of(fresh, found, whole, conf.ts_aliases(root), conf.go_module(root), now_ms)
        old = store.read(buckets)
        drop = gone.unionByName(found.select("path")).select(file_id().alias("file_id"))
        merged = {t: without_files(getattr(old, t), drop).unionByName(getattr(new, t)) for t in PER_FILE}
        again = told.where("touched").select("path", F.col("mtime").alias("seen"))
        merged["files"] = merged["files"].join(again, "path", "left").withColumn("mtime", F.coalesce("seen", "mtime")).drop("seen").select(*schema("files").fieldNames())
        only = ["files"] if not (counts["indexed"] or counts["removed"]) else PER_FILE
        deltas = None if only == ["files"] else frequency_changes(new.tfidf, old.tfidf, drop)
        store.write(Index(**merged, idf=old.idf, sessions=old.sessions), only, buckets, deltas, refresh_idf)
    if refresh_idf and store.meta().get("pending"):
        store.write(store.read(), ["idf"])
    for df in (whole, status, told, found):
        df.unpersist()
    return {"indexed": counts["indexed"], "skipped": counts["seen"] - counts["indexed"] - counts["failed"], "removed": counts["removed"], "errors": counts["failed"], "time_ms": round(1000 * (time.monotonic() - began))}


def reindex(spark: SparkSession, root: str, store: Store, path: str | None = None, now_ms: int = 0, config: conf.Config | None = None) -> dict[str, int]:
    """Read one file, or all, again whatever its time; the counts of ``index_project``."""
    buckets = None if path is None else [r[0] for r in spark.range(1).select(store.bucket(file_id(F.lit(path)))).collect()]
    index = store.read(buckets)
    index.files = invalidated(index.files, path)
    store.write(index, ["files"], buckets)
    return index_project(spark, root, store, now_ms, config, paths=None if path is None else [path])


def apply_events(spark: SparkSession, root: str, store: Store, now_ms: int = 0, refresh_idf: bool = True):
    """A function for ``streaming.events.watch``: reindex the paths of a batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        index_project(spark, root, store, now_ms, paths=batch, refresh_idf=refresh_idf)

    return apply

