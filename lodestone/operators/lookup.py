"""Symbol lookup, references, dead code, patterns and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ilike, ilike_any, name_matches, name_pattern, path_under
from lodestone.operators.trigrams import names_like, names_like_any

# The name patterns of each search.
HTTP_CALLS = ("fetch%", "axios%", "http.%", "https.%", "requests.%", "urllib%", "httpx.%", "aiohttp.%", "reqwest::%", "reqwest.%", "hyper::%", "ureq::%")
ENV_ACCESS = ("process.env%", "os.environ%", "os.getenv%", "os.Getenv%", "os.LookupEnv%", "env::var%", "std::env::var%")
ERROR_CALLS = ("%.catch%", "console.error%")
ERROR_TERMS = ("catch", "except", "recover")
TODO_TERMS = ("todo", "fixme", "hack", "xxx")
TEST_PATHS = ("%.test.%", "%.spec.%", "%__tests__%", "%test/%", "%!_test.go", "%!_test.py", "%/test!_%", "test!_%", "%!_test.rs", "%/tests/%.rs")
PATTERNS = ("http_calls", "env_access", "async_functions", "error_handlers", "todos", "test_files")


def find_symbol(symbols: DataFrame, files: DataFrame, query: str, kind: str | None = None, scope: str | None = None, limit: int = 100, grams: DataFrame | None = None) -> DataFrame:
    """Definitions whose name matches, in order of name, path, line and kind; the symbol's id decides ties, so a cut list is one.

    With ``grams`` (``trigrams.postings``) only the postings of the query's trigrams are read to find the names.
    """
    if grams is None:
        hit = symbols.where(name_matches(F.col("name"), query))
    else:
        hit = symbols.join(names_like(grams, "symbol", name_pattern(query)), ["name", "file_id"], "left_semi")
    if kind:
        hit = hit.where(F.col("kind") == kind)
    placed = hit.join(files.where(path_under(F.col("path"), scope)).select("file_id", "path"), "file_id")
    return placed.select("symbol_id", "file_id", "name", "kind", "path", "start_line", "end_line", "is_exported", "signature", "doc").orderBy("name", "path", "start_line", "kind", "symbol_id").limit(limit)


def importers_of(imports: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """``(path, symbol, from_path)`` of internal imports, by the importing file."""
    found = imports.where("not is_external").join(files.select("file_id", "path"), "file_id").select("path", "symbol", "from_path", "is_type_only", "seq")
    return found if limit is None else found.orderBy("path", "seq", "symbol").limit(limit)


def callers(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``(callee_name, caller, path, line)`` of every stored call."""
    who = symbols.select(F.col("symbol_id").alias("caller_symbol_id"), F.col("name").alias("caller"))
    return calls.join(who, "caller_symbol_id").join(files.select("file_id", "path"), "file_id").select("callee_name", "caller", "path", "line")


def find_references(symbols: DataFrame, files: DataFrame, imports: DataFrame, calls: DataFrame, symbol: str, file: str | None = None, limit: int | None = 500) -> DataFrame:
    """Imports and calls of a symbol: ``(kind, path, line, context)``, each place once.

    ``limit`` is for each of the two; None is none.

    Definitions match without regard to case; ``file`` narrows them, and so the
    imports, but not the calls. Imported and called names match exactly.
    """
    defined = symbols.where(name_matches(F.col("name"), symbol)).join(files.select("file_id", "path"), "file_id")
    if file:
        defined = defined.where(F.col("path") == file)
    home = defined.select(F.col("path").alias("from_path")).distinct()
    names = [symbol, f"* as {symbol}"]
    imported = importers_of(imports, files).where(F.col("symbol").isin(names)).join(home, "from_path", "left_semi")
    called = callers(calls, symbols, files).where(F.col("callee_name").isin(symbol, f"this.{symbol}"))
    a = imported.select(F.lit("import").alias("kind"), "path", F.lit(None).cast("int").alias("line"), F.col("symbol").alias("context")).distinct()
    b = called.select(F.lit("call").alias("kind"), "path", "line", F.col("caller").alias("context")).distinct()
    if limit is not None:
        a, b = a.orderBy("path", "context").limit(limit), b.orderBy("path", "line", "context").limit(limit)
    return a.unionByName(b)


def unused_exports(exports: DataFrame, files: DataFrame, imports: DataFrame, symbols: DataFrame, scope: str | None = None, limit: int = 200) -> DataFrame:
    """Exports that no internal import names and no re-export passes on."""
    named = exports.where("not is_reexport").join(files.where(path_under(F.col("path"), scope)).select("file_id", "path"), "file_id")
    used = imports.where("not is_external").select("symbol", F.col("from_path").alias("path")).distinct()
    passed = exports.where("is_reexport and original_path is not null").select("symbol", F.col("original_path").alias("path")).distinct()
    left = named.join(used, ["symbol", "path"], "left_anti").join(passed, ["symbol", "path"], "left_anti")
    at = symbols.select("file_id", F.col("name").alias("symbol"), "start_line")
    return left.join(at, ["file_id", "symbol"], "left").select("path", "symbol", "kind", "start_line").orderBy("path", "symbol", "start_line").limit(limit)


def unused_code(symbols: DataFrame, files: DataFrame, refs: DataFrame, imports: DataFrame, exports: DataFrame, scope: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """Unexported symbols whose name is referenced nowhere, imported nowhere and passed on nowhere."""
    own = symbols.where("not is_exported")
    if kind:
        own = own.where(F.col("kind") == kind)
    placed = own.join(files.where(path_under(F.col("path"), scope)).select("file_id", "path"), "file_id")
    used = imports.where("not is_external").select(F.col("symbol").alias("name"), F.col("from_path").alias("path")).distinct()
    passed = exports.where("is_reexport and original_path is not null").select(F.col("symbol").alias("name"), F.col("original_path").alias("path")).distinct()
    left = placed.join(refs.select("name").distinct(), "name", "left_anti").join(used, ["name", "path"], "left_anti").join(passed, ["name", "path"], "left_anti")
    return left.select("path", "name", "kind", "start_line", "end_line").orderBy("path", "start_line", "name").limit(limit)


def calls_like(calls: DataFrame, symbols: DataFrame, files: DataFrame, patterns: tuple[str, ...], grams: DataFrame | None = None) -> DataFrame:
    """Calls whose name fits a pattern; with ``grams`` the names are found by their postings."""
    if grams is not None:
        named = names_like_any(grams, "call", patterns).withColumnRenamed("name", "callee_name")
        calls = calls.join(named, ["callee_name", "file_id"], "left_semi")
    return callers(calls, symbols, files).where(ilike_any(F.col("callee_name"), patterns)).distinct().orderBy("path", "line", "callee_name", "caller")


def files_with_terms(tfidf: DataFrame, files: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    return tfidf.where(F.col("term").isin(*terms)).join(files.select("file_id", "path"), "file_id").select("path").distinct()


def is_test_path(path: Column) -> Column:
    return ilike_any(path, TEST_PATHS)


def search_by_pattern(index, pattern: str) -> DataFrame:
    """Rows ``(path, line, name, caller)`` of one of ``PATTERNS``; null where a pattern has none."""
    i = index
    shape = lambda df, **c: df.select("path", *[(c[k] if k in c else F.lit(None).cast(t)).alias(k) for k, t in (("line", "int"), ("name", "string"), ("caller", "string"))])
    if pattern in ("http_calls", "env_access"):
        found = calls_like(i.calls, i.symbols, i.files, HTTP_CALLS if pattern == "http_calls" else ENV_ACCESS, i.grams)
        return shape(found, line=F.col("line"), name=F.col("callee_name"), caller=F.col("caller")).orderBy("path", "line", "name")
    if pattern == "async_functions":
        found = i.symbols.where("kind = 'function'").where(ilike(F.col("signature"), "async %")).join(i.files.select("file_id", "path"), "file_id")
        return shape(found, line=F.col("start_line"), name=F.col("name")).orderBy("path", "line", "name")
    if pattern == "error_handlers":
        by_call = calls_like(i.calls, i.symbols, i.files, ERROR_CALLS, i.grams)
        first = by_call.groupBy("path", F.col("caller").alias("name")).agg(F.min("line").alias("line"))
        by_term = files_with_terms(i.tfidf, i.files, ERROR_TERMS).join(by_call.select("path").distinct(), "path", "left_anti")
        return shape(first, line=F.col("line"), name=F.col("name")).unionByName(shape(by_term, name=F.lit("(try/catch)"))).orderBy("path", "line", "name")
    if pattern == "todos":
        return shape(files_with_terms(i.tfidf, i.files, TODO_TERMS)).orderBy("path")
    if pattern == "test_files":
        return shape(i.files.where(is_test_path(F.col("path"))), line=F.col("lines")).orderBy("path")
    raise ValueError(f"unknown pattern {pattern!r}; there are {', '.join(PATTERNS)}")


def table_stats(index) -> DataFrame:
    """One row of counts: files, symbols, imports, exports, calls."""
    counts = [getattr(index, t).agg(F.count("*").alias(t)) for t in ("files", "symbols", "imports", "exports", "calls")]
    return reduce(lambda a, b: a.crossJoin(b), counts)  # each is one row
