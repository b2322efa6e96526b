"""Dependency search by levels, call trees, directory roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import ancestors, name_matches
from lodestone.lineage import cut


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(src, dst, seq)``: the importing and the imported path, external ones left out."""
    return imports.where("not is_external").join(files.select("file_id", F.col("path").alias("src")), "file_id").select("src", F.col("from_path").alias("dst"), "import_id", "seq")


def dependency_levels(edges: DataFrame, root: str, direction: str = "dependents", depth: int = 3) -> DataFrame:
    """``(path, depth, via)`` of every node within ``depth`` steps of ``root``, which is left out.

    A node stands once, at its least depth; ``via`` is the node that reached it
    first, in the order (discoverer's turn, edge order). A node's turn is the list of edges that led to it, so turns compare as the
    order of discovery does, without a rank over all. One small job a level,
    ``depth`` at most: frontier joined with edges, visited nodes removed by an
    anti-join. Edges are read once and kept over the levels; levels are checkpoints.
    """
    if direction not in ("dependents", "dependencies"):
        raise ValueError(f"unknown direction {direction!r}")
    depth = max(1, min(10, depth))
    at, to = ("dst", "src") if direction == "dependents" else ("src", "dst")
    steps = edges.select(F.col(at).alias("at"), F.col(to).alias("to"), F.col("seq").cast("long").alias("seq")).where("at is not null and to is not null").persist()
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(root, [])], "path string, turn array<struct<seq: long, path: string>>")
    seen = frontier.select("path")
    found = spark.createDataFrame([], "path string, depth int, via string")
    for level in range(1, depth + 1):
        reached = frontier.join(steps, F.col("path") == F.col("at")).select("to", F.col("path").alias("via"), "turn", "seq").join(seen, F.col("to") == seen["path"], "left_anti")
        first = F.min(F.struct("turn", "seq", "via")).alias("first")  # a hub's many edges are combined before the shuffle
        fresh = reached.groupBy("to").agg(first).select(F.col("to").alias("path"), F.lit(level).alias("depth"), F.col("first.via").alias("via"), F.concat("first.turn", F.array(F.struct("first.seq", F.col("to").alias("path")))).alias("turn"))
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh.select("path", "depth", "via"))
        seen = seen.unionByName(fresh.select("path"))
        frontier = fresh.select("path", "turn")
    steps.unpersist()
    return found


def symbol_dimension(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One function or variable for each name: the first by path and line."""
    able = symbols.where(F.col("kind").isin("function", "variable")).join(files.select("file_id", "path"), "file_id")
    first = W.partitionBy("name").orderBy("path", "start_line", "symbol_id")
    return able.withColumn("r", F.row_number().over(first)).where("r = 1").select("symbol_id", "name", "path")


def call_edges(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``(caller_id, nth, callee_name, callee_id, path, line)``: each caller's calls once, numbered in their order."""
    names = symbol_dimension(symbols, files).withColumnsRenamed({"name": "callee_name", "symbol_id": "callee_id"})
    each = calls.select(F.col("caller_symbol_id").alias("caller_id"), "seq", "line", "callee_name").distinct()
    nth = F.row_number().over(W.partitionBy("caller_id").orderBy("seq", "line", "callee_name"))
    return each.withColumn("nth", nth).join(names, "callee_name", "left").select("caller_id", "nth", "callee_name", "callee_id", "path", "line")


def call_tree_rows(calls: DataFrame, symbols: DataFrame, files: DataFrame, function: str, file: str | None = None, depth: int = 2) -> DataFrame:
    """``(key, depth, name, path, line, expanded)`` of the tree, in pre-order by ``key``; empty if the function is unknown.

    ``key`` is a place's path: the numbers of the calls that lead to it. A symbol expands once, at the first place in pre-order
    that is less than ``depth`` deep. That place is found by repetition: a pass grows the tree level by level, expanding each
    symbol at the place that the pass before found least (or, if it had none, at the least of the level that meets
    it), and notes the least place of each symbol in what has grown. Once nothing changes, every symbol expands at its least place, which makes
    it the depth-first tree. As a pass settles at least one more symbol, it ends. A pass holds a row a call within reach.
    """
    depth = max(1, min(5, depth))
    able = symbols.where(F.col("kind").isin("function", "variable")).where(name_matches(F.col("name"), function)).join(files.select("file_id", "path"), "file_id")
    if file:
        able = able.where(F.col("path") == file)
    root = able.orderBy("name", "path", "start_line").select(F.array().cast("array<int>").alias("key"), F.lit(0).alias("depth"), "name", F.col("symbol_id").alias("id"), "path", F.lit(None).cast("int").alias("line")).limit(1)
    root, edges, known = cut(root), call_edges(calls, symbols, files).persist(), None
    while True:
        grown = _grown(root, edges, known, depth)
        least = cut(grown.where((F.col("depth") < depth) & F.col("id").isNotNull()).groupBy("id").agg(F.min("key").alias("first")))
        if known is not None and least.join(known, ["id", "first"], "left_anti").isEmpty():
            break
        known = least
    edges.unpersist()
    opens = F.col("first").isNotNull() & (F.col("key") == F.col("first"))
    return grown.join(known, "id", "left").select("key", "depth", "name", "path", F.col("line").cast("int").alias("line"), F.coalesce(opens, F.lit(False)).alias("expanded"))


def _grown(root: DataFrame, edges: DataFrame, known: DataFrame | None, depth: int) -> DataFrame:
    """The places of one pass, level by level."""
    level, out, seen = root, root, root.select("id").limit(0)
    for _ in range(depth):
        if known is None:
            opened = level.where("id is not null").groupBy("id").agg(F.min("key").alias("key")).join(seen, "id", "left_anti")
            seen = seen.unionByName(opened.select("id"))
        else:
            opened = level.join(known, (level["id"] == known["id"]) & (level["key"] == known["first"]), "left_semi").select("id", "key")
        below = opened.join(edges, F.col("id") == F.col("caller_id"))
        at = F.concat("key", F.array(F.col("nth").cast("int")))
        level = cut(below.select(at.alias("key"), F.size(at).alias("depth"), F.col("callee_name").alias("name"), F.col("callee_id").alias("id"), "path", F.col("line").cast("int").alias("line")))
        out = out.unionByName(level)
    return out


def call_tree(calls: DataFrame, symbols: DataFrame, files: DataFrame, function: str, file: str | None = None, depth: int = 2) -> list[dict]:
    """The rows of ``call_tree_rows`` in pre-order, for a text: what one function reaches within five levels."""
    rows = call_tree_rows(calls, symbols, files, function, file, depth).orderBy("key").collect()
    return [{k: r[k] for k in ("depth", "name", "path", "line", "expanded")} for r in rows]


def directory_rollup(files: DataFrame, exports: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``(dir, depth, files, exports)``: all files and own exports below each directory."""
    counted = files.select("file_id", "path")
    if exports is not None:
        own = exports.where("not is_reexport").groupBy("file_id").agg(F.count("*").alias("n"))
        counted = counted.join(own, "file_id", "left")
    else:
        counted = counted.withColumn("n", F.lit(0))
    rows = counted.select(F.explode(ancestors(F.col("path"))).alias("dir"), F.coalesce("n", F.lit(0)).alias("n"))
    up = rows.groupBy("dir").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("exports"))
    up = up.withColumn("depth", F.size(F.split("dir", "/")))
    return (up.where(F.col("depth") <= max_depth) if max_depth else up).select("dir", "depth", "files", "exports")


def project_map(files: DataFrame, exports: DataFrame) -> DataFrame:
    """``(path, exports)``: own exports of every file in their order; files without any stay."""
    own = exports.where("not is_reexport").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "symbol"))), lambda x: x["symbol"]).alias("exports"))
    return files.join(own, "file_id", "left").select("path", F.coalesce("exports", F.array().cast("array<string>")).alias("exports")).orderBy("path")
