"""Which files an incremental run has to read, and what happened to each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_status(listing: DataFrame, files: DataFrame, max_size: int | None = None) -> DataFrame:
    """``(path, status)`` from a listing ``(path, mtime, length)`` and the indexed files.

    ``read``: new, invalidated, or with another mtime; ``unchanged``; ``too_large``
    (indexed rows stay); ``removed``: indexed and not listed.
    """
    known = files.select("path", F.col("mtime").alias("known"), "hash")
    both = listing.select("path", "mtime", "length").join(known, "path", "full_outer")
    large = F.lit(False) if max_size is None else F.col("length") > max_size
    same = F.col("known").isNotNull() & (F.col("hash") != "") & (F.col("mtime") == F.col("known"))
    return both.select("path", F.when(F.col("mtime").isNull(), "removed").when(large, "too_large").when(same, "unchanged").otherwise("read").alias("status"))


def content_status(read: DataFrame, files: DataFrame) -> DataFrame:
    """``read(path, hash, ...)`` with ``touched``: the content is the one that is indexed."""
    return read.join(files.select("path", F.col("hash").alias("known_hash")), "path", "left").withColumn("touched", F.coalesce(F.col("known_hash") == F.col("hash"), F.lit(False))).drop("known_hash")


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("files"))
