"""Differences of two file states by a tree of folder digests.

A folder's digest covers all files below it, whatever their order, so equal digests spare the whole
subtree. The comparison goes down level by level: children of folders that differ are
compared, and in the end the files right in a folder that differs. What two states share costs a row a
folder at most, and nothing below the first equal folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.lineage import cut
from lodestone.operators.changes import changes


def folder_of(path: Column) -> Column:
    """The folder over a file or folder, with a slash before every part; the root is the empty text."""
    return F.regexp_replace(path, "/[^/]*$", "")


def _over(path: Column) -> Column:
    """All folders over a file, the root first. Empty parts of a path are folders too."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def folder_digests(state: DataFrame) -> DataFrame:
    """``(folder, level, files, one, two)`` of a state ``(path, hash, symbols)``; folders begin with a slash, the root is the empty text at level 0.

    Digests are exclusive ors of two hashes of each file below, with the number of files; they are combined
    before the shuffle, so a folder that holds every file is no hot key.
    """
    file = [F.col("path"), F.col("hash"), F.to_json("symbols")]
    each = state.select(F.concat(F.lit("/"), "path").alias("path"), F.xxhash64(F.lit(1), *file).alias("a"), F.xxhash64(F.lit(2), *file).alias("b"))
    rows = each.select(F.posexplode(_over(F.col("path"))).alias("level", "folder"), "a", "b")
    return rows.groupBy("level", "folder").agg(F.count("*").alias("files"), F.bit_xor("a").alias("one"), F.bit_xor("b").alias("two")).select("folder", "level", "files", "one", "two")


def differing_folders(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(folder, level)`` of the folders whose digests differ, top down; those of one state alone differ."""
    found, frontier, level = None, None, 0
    while True:
        sides = [df.where(F.col("level") == level).select("folder", F.struct("files", "one", "two").alias(name)) for df, name in ((now, "new"), (before, "old"))]
        if frontier is not None:
            sides = [s.withColumn("over", folder_of(F.col("folder"))).join(frontier.select(F.col("folder").alias("over")), "over", "left_semi").drop("over") for s in sides]
        both = sides[0].join(sides[1], "folder", "full_outer")
        fresh = cut(both.where(~F.col("new").eqNullSafe(F.col("old"))).select("folder", F.lit(level).alias("level")))
        if fresh.isEmpty():
            return fresh if found is None else found
        found, frontier, level = fresh if found is None else found.unionByName(fresh), fresh, level + 1


def changes_by_folder(now: DataFrame, before: DataFrame, digests_now: DataFrame | None = None, digests_before: DataFrame | None = None) -> DataFrame:
    """The rows of ``changes``, from the files right in folders that differ; digests may be given as they were stored."""
    digests = [cut(folder_digests(s)) if d is None else d for s, d in ((now, digests_now), (before, digests_before))]
    folders = differing_folders(*digests).select(F.col("folder").alias("at"))
    inside = lambda s: s.withColumn("at", folder_of(F.concat(F.lit("/"), "path"))).join(folders, "at", "left_semi").drop("at")
    return changes(inside(now), inside(before))
