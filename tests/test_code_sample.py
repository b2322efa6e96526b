"""Extraction, resolution and the code queries over a sample project in eight languages, against rows written out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash
from lodestone.operators import context as X
from lodestone.operators import graph as G
from lodestone.operators import lookup as L
from lodestone.operators import search as S
from lodestone.plans.index import tables_of, with_idf, without_failed
from lodestone.schema import Index
from tests.sample import MODULE, SOURCES


def sample_index(spark: SparkSession) -> Index:
    read = spark.createDataFrame([(p, t, 1) for p, t in SOURCES.items()], "path string, content string, mtime long").withColumn("hash", content_hash(F.col("content")))
    good, _, found = without_failed(read)
    return with_idf(tables_of(good, found, read.select("path"), (None, []), MODULE, 0))


CASES = {}


def _rows(columns, rows):
    """Expect these rows of the function below."""

    def add(f):
        CASES[f.__name__] = (f, [c.strip().split(" ")[0] for c in columns.split(",")], rows)
        return f

    return add


def _placed(index: Index, table: str) -> DataFrame:
    return getattr(index, table).join(index.files.select("file_id", "path"), "file_id")


@_rows("path VARCHAR, name VARCHAR, kind VARCHAR, start_line INTEGER, end_line INTEGER, is_exported BOOLEAN, doc VARCHAR", [
    ("app/auth/auth.go", "Store", "class", 6, 6, True, "// Store holds names."), ("app/auth/auth.go", "Store.Open", "function", 8, 11, True, None),
    ("app/auth/auth.go", "check", "function", 13, 13, False, None), ("app/main.go", "main", "function", 5, 5, False, None),
    ("lib/tool.py", "Tool", "class", 5, 9, True, "A tool."), ("lib/tool.py", "_hidden", "function", 12, 13, False, None), ("lib/util.py", "load", "function", 1, 2, True, None),
    ("src/Door.cs", "Door", "class", 5, 13, True, None), ("src/Door.cs", "Door.Width", "variable", 7, 7, True, None), ("src/Door.cs", "Door.Shut", "function", 9, 12, True, None),
    ("src/a/Box.java", "Box", "class", 6, 11, True, None), ("src/a/Box.java", "Box.open", "function", 8, 10, True, "/** Opens it. */"),
    ("src/a/Lid.java", "Lid", "interface", 3, 5, True, None), ("src/a/Lid.java", "Lid.lift", "function", 4, 4, True, None),
    ("src/kinds/account.ts", "Account", "interface", 1, 3, True, None), ("src/kinds/account.ts", "Role", "enum", 5, 7, True, None), ("src/kinds/account.ts", "Key", "type", 9, 9, True, None),
    ("src/lib.rs", "Desk", "class", 3, 5, True, None), ("src/lib.rs", "Desk.tidy", "function", 8, 10, True, None), ("src/lib.rs", "helper", "function", 13, 15, False, None),
    ("src/lib/text.ts", "digest", "function", 1, 3, True, None), ("src/lib/text.ts", "Words", "class", 5, 9, True, None),
    ("src/main.ts", "onEnter", "function", 5, 8, True, None), ("src/main.ts", "onLeave", "function", 10, 12, True, None), ("src/old.js", "plain", "function", 3, 5, False, None),
    ("src/session.ts", "LIMIT", "variable", 3, 3, True, None), ("src/session.ts", "NEVER", "variable", 4, 4, False, None), ("src/session.ts", "signIn", "function", 7, 13, True, "/** Begins a session. */"),
    ("src/session.ts", "prepare", "function", 15, 17, False, None), ("src/session.ts", "signOut", "function", 19, 21, True, None),
    ("src/store.rs", "Shelf", "interface", 1, 3, True, None), ("src/view.tsx", "View", "function", 3, 5, True, None),
])
def code_symbols(spark):
    return _placed(sample_index(spark), "symbols").select("path", "name", "kind", "start_line", "end_line", "is_exported", "doc")


@_rows("path VARCHAR, symbol VARCHAR, from_path VARCHAR, is_type_only BOOLEAN, is_external BOOLEAN", [
    ("app/auth/auth.go", "fmt", "fmt", False, True), ("app/main.go", "auth", "app/auth/auth.go", False, False),
    ("lib/tool.py", "os", "os", False, True), ("lib/tool.py", "get", "lib/util.py", False, False), ("src/Door.cs", "System", "System", False, True),
    ("src/a/Box.java", "Lid", "src/a/Lid.java", False, False), ("src/a/Box.java", "List", "java.util.List", False, True), ("src/lib.rs", "Shelf", "src/store.rs", False, False),
    ("src/main.ts", "signIn", "src/session.ts", False, False), ("src/main.ts", "signOut", "src/session.ts", False, False), ("src/main.ts", "Account", "src/kinds/index.ts", True, False),
    ("src/main.ts", "* as path", "path", False, True), ("src/session.ts", "digest", "src/lib/text.ts", False, False), ("src/view.tsx", "onEnter", "src/main.ts", False, False),
])
def code_imports(spark):
    return _placed(sample_index(spark), "imports").select("path", "symbol", "from_path", "is_type_only", "is_external")


@_rows("path VARCHAR, symbol VARCHAR, is_reexport BOOLEAN, original_path VARCHAR", [
    ("app/auth/auth.go", "Store", False, None), ("app/auth/auth.go", "Store.Open", False, None), ("lib/tool.py", "Tool", False, None), ("lib/util.py", "load", False, None),
    ("src/Door.cs", "Door", False, None), ("src/Door.cs", "Door.Width", False, None), ("src/Door.cs", "Door.Shut", False, None), ("src/a/Box.java", "Box", False, None), ("src/a/Box.java", "Box.open", False, None),
    ("src/a/Lid.java", "Lid", False, None), ("src/a/Lid.java", "Lid.lift", False, None), ("src/kinds/account.ts", "Account", False, None), ("src/kinds/account.ts", "Role", False, None), ("src/kinds/account.ts", "Key", False, None),
    ("src/kinds/index.ts", "Account", True, "src/kinds/account.ts"), ("src/kinds/index.ts", "Role", True, "src/kinds/account.ts"), ("src/lib.rs", "Desk", False, None), ("src/lib.rs", "Desk.tidy", False, None),
    ("src/lib/text.ts", "digest", False, None), ("src/lib/text.ts", "Words", False, None), ("src/main.ts", "onEnter", False, None), ("src/main.ts", "onLeave", False, None),
    ("src/session.ts", "LIMIT", False, None), ("src/session.ts", "signIn", False, None), ("src/session.ts", "signOut", False, None), ("src/store.rs", "Shelf", False, None), ("src/view.tsx", "View", False, None),
])
def code_exports(spark):
    return _placed(sample_index(spark), "exports").select("path", "symbol", "is_reexport", "original_path")


@_rows("path VARCHAR, caller VARCHAR, callee_name VARCHAR, line INTEGER", [
    ("app/auth/auth.go", "Store.Open", "fmt.Println", 9), ("app/auth/auth.go", "Store.Open", "check", 10), ("app/main.go", "main", "auth.New", 5), ("lib/util.py", "load", "open", 2),
    ("src/Door.cs", "Door.Shut", "Console.WriteLine", 11), ("src/a/Box.java", "Box.open", "lid.lift", 9), ("src/lib/text.ts", "digest", "String", 2),
    ("src/main.ts", "onEnter", "console.log", 6), ("src/main.ts", "onEnter", "signIn", 7), ("src/main.ts", "onLeave", "signOut", 11), ("src/old.js", "plain", "digest", 4),
    ("src/session.ts", "signIn", "digest", 9), ("src/session.ts", "signIn", "prepare", 9), ("src/session.ts", "signIn", "console.error", 11), ("src/session.ts", "prepare", "x.trim", 16),
    ("src/session.ts", "signOut", "fetch", 20), ("src/view.tsx", "View", "onEnter", 4),
])
def code_calls(spark):
    i = sample_index(spark)
    return L.callers(i.calls, i.symbols, i.files).select("path", "caller", "callee_name", "line")


@_rows("pattern VARCHAR, path VARCHAR, line INTEGER, name VARCHAR, caller VARCHAR", [
    ("async_functions", "src/main.ts", 5, "onEnter", None), ("async_functions", "src/session.ts", 7, "signIn", None),
    ("error_handlers", "src/session.ts", 11, "signIn", None), ("http_calls", "src/session.ts", 20, "fetch", "signOut"),
])
def code_patterns(spark):
    i, out = sample_index(spark), None
    for p in ("async_functions", "error_handlers", "http_calls", "env_access"):
        found = L.search_by_pattern(i, p).select(F.lit(p).alias("pattern"), "path", F.col("line").cast("int").alias("line"), "name", "caller")
        out = found if out is None else out.unionByName(found)
    return out


@_rows("place INTEGER, depth INTEGER, name VARCHAR, path VARCHAR, line INTEGER, expanded BOOLEAN", [
    (0, 0, "onEnter", "src/main.ts", None, True), (1, 1, "console.log", None, 6, False), (2, 1, "signIn", "src/session.ts", 7, True), (3, 2, "prepare", "src/session.ts", 9, True),
    (4, 3, "x.trim", None, 16, False), (5, 2, "digest", "src/lib/text.ts", 9, True), (6, 3, "String", None, 2, False), (7, 2, "console.error", None, 11, False),
])
def code_call_tree(spark):
    i = sample_index(spark)
    rows = G.call_tree(i.calls, i.symbols, i.files, "onEnter", None, 3)
    return spark.createDataFrame([(k, r["depth"], r["name"], r["path"], r["line"], r["expanded"]) for k, r in enumerate(rows)], "place int, depth int, name string, path string, line int, expanded boolean")


@_rows("symbol VARCHAR, from_path VARCHAR, kind VARCHAR, start_line INTEGER", [("signIn", "src/session.ts", "function", 7), ("signOut", "src/session.ts", "function", 19), ("Account", "src/kinds/index.ts", None, None), ("* as path", "path", None, None)])
def code_context_imports(spark):
    return X.smart_context(sample_index(spark), "src/main.ts")["imports"].select("symbol", "from_path", "kind", "start_line")


@_rows("path VARCHAR, lines INTEGER, exports VARCHAR[], internal_imports VARCHAR[], external_imports VARCHAR[], imported_by VARCHAR[]", [("src/session.ts", 22, ["LIMIT", "signIn", "signOut"], ["src/lib/text.ts"], [], ["src/main.ts"])])
def code_file_summary(spark):
    return X.file_summary(sample_index(spark), "src/session.ts", 0).select("path", "lines", "exports", "internal_imports", "external_imports", "imported_by")


@_rows("path VARCHAR, name VARCHAR, from_line INTEGER, to_line INTEGER, source VARCHAR", [
    ("app/auth/auth.go", "Store", 5, 6, "// Store holds names.\ntype Store struct{ n int }"), ("src/a/Box.java", "Box.open", 7, 10, "    /** Opens it. */\n    public void open(Lid lid) {\n        lid.lift();\n    }"),
    ("src/kinds/account.ts", "Key", 9, 9, "export type Key = string"),
])
def code_symbol_source(spark):
    i = sample_index(spark)
    hits = [X.symbol_source(i, n).select("path", "name", "from_line", "to_line", "source") for n in ("Store", "Box.open", "Key")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


@_rows("path VARCHAR, depth INTEGER, via VARCHAR", [("src/session.ts", 1, "src/lib/text.ts"), ("src/main.ts", 2, "src/session.ts"), ("src/view.tsx", 3, "src/main.ts")])
def code_dependents(spark):
    i = sample_index(spark)
    return G.dependency_levels(G.import_edges(i.imports, i.files), "src/lib/text.ts", "dependents", 3).select("path", "depth", "via")


@_rows("path VARCHAR, name VARCHAR, start_line INTEGER", [("lib/tool.py", "_hidden", 12), ("src/session.ts", "NEVER", 4)])
def code_unused(spark):
    i = sample_index(spark)
    return L.unused_code(i.symbols, i.files, i.refs, i.imports, i.exports).select("path", "name", "start_line")


@_rows("path VARCHAR, symbol VARCHAR", [
    ("app/auth/auth.go", "Store"), ("app/auth/auth.go", "Store.Open"), ("lib/tool.py", "Tool"), ("lib/util.py", "load"), ("src/Door.cs", "Door"), ("src/Door.cs", "Door.Shut"), ("src/Door.cs", "Door.Width"), ("src/a/Box.java", "Box"), ("src/a/Box.java", "Box.open"),
    ("src/a/Lid.java", "Lid.lift"), ("src/kinds/account.ts", "Key"), ("src/lib.rs", "Desk"), ("src/lib.rs", "Desk.tidy"), ("src/lib/text.ts", "Words"), ("src/main.ts", "onLeave"), ("src/session.ts", "LIMIT"), ("src/view.tsx", "View"),
])
def code_unused_exports(spark):
    i = sample_index(spark)
    return L.unused_exports(i.exports, i.files, i.imports, i.symbols).select("path", "symbol")


@_rows("path VARCHAR", [("src/session.ts",), ("src/lib/text.ts",)])
def code_search(spark):
    """Files with a rare word of the question; ``ln(16 / 1)`` weighs words of one file most."""
    i = sample_index(spark)
    return S.search_code(i.files, i.exports, i.tfidf, i.idf, "begins words", 10).select("path")


@pytest.mark.parametrize("name", sorted(CASES))
def test_sample(spark, name):
    run, columns, rows = CASES[name]
    found = run(spark)
    assert found.columns == columns
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, map(tuple, rows)))
