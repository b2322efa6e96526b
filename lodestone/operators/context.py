"""Views of one file or symbol: context, summary, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import age_text, name_matches
from lodestone.operators.lookup import importers_of


def with_targets(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imports with what they resolve to: one row for each same-named symbol in the file they name."""
    target = files.select(F.col("file_id").alias("to_id"), F.col("path").alias("from_path"))
    at = symbols.select(F.col("file_id").alias("to_id"), F.col("name").alias("symbol"), "kind", "signature", "start_line")
    return imports.join(target, "from_path", "left").join(at, ["to_id", "symbol"], "left").select("file_id", "seq", "symbol", "from_path", "is_type_only", "is_external", "kind", "signature", "start_line")


def file_imports(imports: DataFrame, files: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """Imports of one file with what they resolve to, in order."""
    home = files.where(F.col("path") == path).select("file_id")
    own = imports.join(F.broadcast(home), "file_id", "left_semi")  # one row
    return with_targets(own, files, symbols).drop("file_id").orderBy("seq", "start_line")


def candidate_tests(path: str) -> list[str]:
    """Paths at which a file's tests are looked for, best first."""
    folder, _, base = path.rpartition("/")
    stem, _, ext = base.rpartition(".")
    at = f"{folder}/" if folder else ""
    if ext == "py":
        return [f"{at}test_{base}", f"{at}{stem}_test.py", f"{at}tests/test_{base}", f"tests/test_{base}"]
    if ext == "go":
        return [f"{at}{stem}_test.go"]
    if ext == "rs":
        return [f"{at}{stem}_test.rs", f"tests/{stem}_test.rs"]
    kinds = ("ts", "tsx", "js", "jsx", "mjs")
    return [f"{at}{x}" for e in kinds for x in (f"{stem}.test.{e}", f"{stem}.spec.{e}", f"__tests__/{stem}.test.{e}")]


def test_file(files: DataFrame, path: str) -> DataFrame:
    """The first of a file's candidate tests that is indexed: one row or none."""
    spark = files.sparkSession
    wanted = spark.createDataFrame(list(enumerate(candidate_tests(path))), "pos int, path string")
    return files.join(F.broadcast(wanted), "path").orderBy("pos").select("path").limit(1)  # 15 rows at most


def smart_context(index, path: str) -> dict[str, DataFrame]:
    """What one needs to know to edit a file: its symbols, imports, importers and test."""
    home = index.files.where(F.col("path") == path)
    own = index.symbols.join(F.broadcast(home.select("file_id")), "file_id", "left_semi")  # one row
    return {
        "file": home,
        "symbols": own.orderBy("start_line", "seq"),
        "imports": file_imports(index.imports, index.files, index.symbols, path),
        "importers": importers_of(index.imports, index.files).where(F.col("from_path") == path).orderBy("path", "seq", "symbol").limit(500),
        "test": test_file(index.files, path),
    }


def distinct_in_order(rows: DataFrame, value: str, order: str, by: str | None = None) -> DataFrame:
    """Each value once, at its first place."""
    keys = [by] if by else []
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order)).orderBy(*keys, order, value)


def file_summary(index, path: str, now_ms: int) -> DataFrame:
    """One row: lines, age, exports and imports in order (repeats kept), importing files once each."""
    listed = lambda df, c: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]).alias("v"))
    home = index.files.where(F.col("path") == path)
    mine = F.broadcast(home.select("file_id"))  # one row
    exports = listed(index.exports.where("not is_reexport").join(mine, "file_id", "left_semi"), "symbol").withColumnRenamed("v", "exports")
    internal = listed(index.imports.where("not is_external").join(mine, "file_id", "left_semi"), "from_path").withColumnRenamed("v", "internal_imports")
    external = listed(index.imports.where("is_external").join(mine, "file_id", "left_semi"), "from_path").withColumnRenamed("v", "external_imports")
    by = importers_of(index.imports, index.files).where(F.col("from_path") == path).agg(F.array_sort(F.collect_set("path")).alias("imported_by"))
    told = home.select("path", "lines", age_text(F.col("indexed_at"), F.lit(now_ms)).alias("indexed"))
    return told.crossJoin(exports).crossJoin(internal).crossJoin(external).crossJoin(by)  # one row each


def source_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text, both included, from 1."""
    return F.slice(F.split(content, "\n", -1), start, F.greatest(end - start + 1, F.lit(0)))


def doc_start(content: Column, start: Column) -> Column:
    """First line of the comment block right above ``start``, or ``start``."""
    above = F.reverse(F.slice(F.split(content, "\n", -1), 1, start - 1))
    is_doc = lambda x: x.rlike(r"^\s*(/\*\*|\*|//)")
    run = F.aggregate(above, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & is_doc(x)).cast("int")).alias("n"), (s["on"] & is_doc(x)).alias("on")))
    return start - run["n"]


def symbol_source(index, symbol: str, file: str | None = None) -> DataFrame:
    """``(path, name, kind, is_exported, signature, start_line, from_line, to_line, source)`` of the matching definitions."""
    hit = index.symbols.where(name_matches(F.col("name"), symbol)).join(index.files.select("file_id", "path"), "file_id")
    if file:
        hit = hit.where(F.col("path") == file)
    return with_source(hit, index.contents).orderBy("name", "path", "from_line")


def with_source(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """Definitions (with their ``path``) and their text, from the comment above on."""
    read = symbols.join(contents, "file_id")
    begin = F.when(F.coalesce("doc", F.lit("")) != "", doc_start(F.col("content"), F.col("start_line"))).otherwise(F.col("start_line"))
    placed = read.withColumn("from_line", begin)
    return placed.select("path", "name", "kind", "is_exported", "signature", "start_line", "from_line", F.col("end_line").alias("to_line"), F.array_join(source_lines(F.col("content"), F.col("from_line"), F.col("end_line")), "\n").alias("source"))
