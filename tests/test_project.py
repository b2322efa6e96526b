"""A small project in four languages: index, query, change, index again."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes as C
from lodestone.operators import context as X
from lodestone.operators import graph as G
from lodestone.operators import lookup as L
from lodestone.operators import search as S
from lodestone.plans.index import index_project
from lodestone.plans.resolve import candidates
from lodestone.sources import config as conf
from lodestone.sources.store import Store

FILES = {
    "src/main.ts": "import { signIn, signOut } from './session.js'\nimport type { Account } from './kinds/index.js'\nimport { helper } from '@lib/text'\n\nexport async function onEnter(a: Account) {\n  console.log(a)\n  return signIn(a)\n}\n\nexport function onLeave(a: Account) {\n  return signOut(a)\n}\n",
    "src/session.ts": "import { digest } from './lib/text.js'\n\nexport const LIMIT = 3\nconst NEVER = 1\nconst START = 'x'\n\n/** Begins a session. */\nexport async function signIn(a: object, mark = START) {\n  // TODO: lock after LIMIT attempts\n  try {\n    return prepare(digest(a))\n  } catch (e) {\n    console.error(e)\n  }\n}\n\nfunction prepare(x: string) {\n  return x.trim()\n}\n\nfunction orphan() {\n  return prepare('')\n}\n\nexport function signOut(a: object) {\n  return fetch('/out')\n}\n",
    "src/lib/text.ts": "export function digest(x: object): string {\n  return String(x)\n}\n\nexport function helper() {\n  return digest({})\n}\n\nexport function lonely() {}\n",
    "src/kinds/index.ts": "export { Account, Role } from './account.js'\n",
    "src/kinds/account.ts": "export interface Account {\n  id: string\n}\n\nexport enum Role {\n  A,\n}\n",
    "src/session.test.ts": "import { signIn } from './session'\n",
    "src/types.d.ts": "declare const X: number\n",
    "lib/tool.py": "import os\nfrom .util import load as get\n\n\n@cached\ndef run(path: str) -> int:\n    \"\"\"Runs.\"\"\"\n    return get(os.getenv(path))\n\n\ndef _hidden():\n    pass\n",
    "lib/util.py": "def load(x):\n    return open(x)\n",
    "app/auth/auth.go": "package auth\n\nimport \"fmt\"\n\ntype Store struct{ n int }\n\nfunc (s *Store) Open(name string) error {\n\tfmt.Println(name)\n\treturn check(name)\n}\n\nfunc check(name string) error { return nil }\n",
    "app/main.go": "package main\n\nimport \"example.com/demo/app/auth\"\n\nfunc main() { auth.New() }\n",
    "go.mod": "module example.com/demo\n",
    "tsconfig.json": "{\n  // aliases\n  \"compilerOptions\": { \"baseUrl\": \".\", \"paths\": { \"@lib/*\": [\"src/lib/*\"], \"@all\": [\"src/**/*.ts\"] }, }\n}\n",
    "node_modules/x/index.js": "export const gone = 1\n",
}


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as out:
            out.write(text)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root, store = str(tmp_path_factory.mktemp("tree")), str(tmp_path_factory.mktemp("store"))
    write(root, FILES)
    s = Store(spark, "file://" + store)
    told = index_project(spark, root, s, now_ms=1000, config=conf.Config(exclude=["**/*.test.*"]))
    return root, s, told


@pytest.fixture(scope="module")
def index(project):
    return project[1].read()


def counts(told):
    return {k: v for k, v in told.items() if k != "time_ms"}


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_files_and_symbols(index, project):
    assert counts(project[2]) == {"indexed": 9, "skipped": 0, "removed": 0, "errors": 0} and project[2]["time_ms"] > 0
    names = dict(rows(index.files, "path", "lines"))
    assert set(names) == {k for k in FILES if k.endswith((".ts", ".py", ".go")) and ".test." not in k and ".d." not in k}
    assert names["src/lib/text.ts"] == 10
    at = {r["name"]: r for r in L.find_symbol(index.symbols, index.files, "*", scope="SRC/session").collect()}
    assert {n: (r["kind"], r["start_line"], r["end_line"], r["is_exported"]) for n, r in at.items()} == {
        "LIMIT": ("variable", 3, 3, True),
        "NEVER": ("variable", 4, 4, False),
        "START": ("variable", 5, 5, False),
        "signIn": ("function", 8, 15, True),
        "prepare": ("function", 17, 19, False),
        "orphan": ("function", 21, 23, False),
        "signOut": ("function", 25, 27, True),
    }
    assert at["signIn"]["doc"] == "/** Begins a session. */"
    assert rows(L.find_symbol(index.symbols, index.files, "store.open"), "name", "path") == [("Store.Open", "app/auth/auth.go")]
    assert L.find_symbol(index.symbols, index.files, "sign_n").count() == 0


def test_imports_are_resolved(index):
    found = {(r["path"], r["symbol"]): (r["from_path"], r["is_external"]) for r in index.imports.join(index.files, "file_id").collect()}
    assert found[("src/main.ts", "signIn")] == ("src/session.ts", False)
    assert found[("src/main.ts", "Account")] == ("src/kinds/index.ts", False)
    assert found[("src/main.ts", "helper")] == ("src/lib/text.ts", False)
    assert found[("lib/tool.py", "os")] == ("os", True)
    assert found[("lib/tool.py", "get")] == ("lib/util.py", False)
    assert found[("app/main.go", "auth")] == ("app/auth/auth.go", False)
    assert found[("app/auth/auth.go", "fmt")] == ("fmt", True)
    assert rows(index.exports.where("is_reexport"), "symbol", "original_path") == [("Account", "src/kinds/account.ts"), ("Role", "src/kinds/account.ts")]


def test_candidates():
    assert candidates("./a/b.js", "src/x.ts", "typescript")[0][:2] == ["src/a/b.js", "src/a/b.ts"]
    assert candidates("react", "src/x.ts", "typescript") == ([], None)
    assert candidates("..m.n", "a/b/c.py", "python") == (["a/m/n.py", "a/m/n/__init__.py"], "a/m/n")
    assert "src/auth.rs" in candidates("crate::auth::login", "src/main.rs", "rust")[0]
    assert candidates("a.b.C", "src/X.java", "java")[0][0] == "src/main/java/a/b/C.java"
    assert candidates("System", "X.cs", "c_sharp") == ([], None)


def test_references_and_dead_code(index):
    found = set(rows(L.find_references(index.symbols, index.files, index.imports, index.calls, "signIn"), "kind", "path", "line"))
    assert found == {("import", "src/main.ts", None), ("call", "src/main.ts", 7)}
    assert L.find_references(index.symbols, index.files, index.imports, index.calls, "signIn", "no/such.ts").where("kind = 'import'").count() == 0
    dead = set(rows(L.unused_code(index.symbols, index.files, index.refs, index.imports, index.exports), "path", "name"))
    assert ("src/session.ts", "NEVER") in dead and ("src/session.ts", "orphan") in dead
    assert not {n for _, n in dead} & {"START", "prepare", "check"}
    unused = {n for _, n in rows(L.unused_exports(index.exports, index.files, index.imports, index.symbols, "src/"), "path", "symbol")}
    assert unused == {"onEnter", "onLeave", "LIMIT", "lonely"}


def test_graphs(index):
    edges = G.import_edges(index.imports, index.files)
    assert set(rows(G.dependency_levels(edges, "src/lib/text.ts"), "path", "depth", "via")) == {("src/session.ts", 1, "src/lib/text.ts"), ("src/main.ts", 1, "src/lib/text.ts")}
    assert set(rows(G.dependency_levels(edges, "src/main.ts", "dependencies"), "path", "depth")) == {("src/session.ts", 1), ("src/kinds/index.ts", 1), ("src/lib/text.ts", 1)}
    tree = G.call_tree(index.calls, index.symbols, index.files, "onenter", depth=3)
    assert [(r["depth"], r["name"], r["line"]) for r in tree] == [(0, "onEnter", None), (1, "console.log", 6), (1, "signIn", 7), (2, "prepare", 11), (3, "x.trim", 18), (2, "digest", 11), (3, "String", 2), (2, "console.error", 13)]
    assert G.call_tree(index.calls, index.symbols, index.files, "nothing") == []
    assert set(rows(G.directory_rollup(index.files, index.exports), "dir", "files", "exports")) >= {("src", 5, 10), ("src/kinds", 2, 2), ("app/auth", 1, 2)}
    assert dict(rows(G.project_map(index.files, index.exports), "path", "exports"))["src/kinds/index.ts"] == []


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0)], "src string, dst string, seq int")
    assert set(rows(G.dependency_levels(edges, "a", "dependencies", 10), "path", "depth", "via")) == {("b", 1, "a"), ("c", 2, "b")}


def test_patterns(index):
    found = lambda p: set(rows(L.search_by_pattern(index, p), "path", "name"))
    assert found("http_calls") == {("src/session.ts", "fetch")}
    assert found("env_access") == {("lib/tool.py", "os.getenv")}
    assert found("async_functions") == {("src/main.ts", "onEnter"), ("src/session.ts", "signIn")}
    assert found("error_handlers") == {("src/session.ts", "signIn")}
    assert {p for p, _ in found("todos")} == {"src/session.ts"}
    with pytest.raises(ValueError):
        L.search_by_pattern(index, "none")


def test_search_and_context(index):
    best = S.search_code(index.files, index.exports, index.tfidf, index.idf, "digest helper").collect()
    assert best[0]["path"] == "src/lib/text.ts" and best[0]["exports"] == ["digest", "helper", "lonely"]
    assert S.search_code(index.files, index.exports, index.tfidf, index.idf, "").count() == 0
    assert X.symbol_source(index, "signIn").first()["source"].startswith("/** Begins a session. */\nexport async function")
    summary = X.file_summary(index, "src/session.ts", 61_000).first()
    assert summary["imported_by"] == ["src/main.ts"] and summary["exports"] == ["LIMIT", "signIn", "signOut"] and summary["indexed"] == "1m ago"
    context = X.smart_context(index, "src/main.ts")
    assert [(r["symbol"], r["kind"]) for r in context["imports"].collect()] == [("signIn", "function"), ("signOut", "function"), ("Account", None), ("helper", "function")]
    assert context["test"].count() == 0
    assert tuple(L.table_stats(index).first())[0] == 9


def test_tools_as_text(index):
    from lodestone import tools

    assert tools.get_status(index).startswith("files: 9\n")
    assert "function signIn" in tools.find_symbol(index, "signIn") and tools.find_symbol(index, "zz").startswith("No symbol")
    assert tools.find_references(index, "signIn").startswith("2 reference(s)") and "No references" in tools.find_references(index, "zz")
    assert "[1] src/main.ts via src/session.ts" in tools.get_dependency_graph(index, "src/session.ts") and "not indexed" in tools.get_dependency_graph(index, "zz")
    assert tools.get_call_graph(index, "onLeave").splitlines()[1] == "└── signOut (src/session.ts:11)"
    assert "export async function" in tools.get_symbol_source(index, "signIn")
    assert tools.get_project_map(index, 1).startswith("app/ (2 files, 2 exports)\n  auth/ ...")
    assert "orphan" in tools.find_unused_code(index) and "lonely" in tools.find_unused_exports(index)
    assert tools.search_by_pattern(index, "http_calls") == "http_calls: 1\n  src/session.ts:26 fetch in signOut"
    assert tools.search_by_pattern(index, "zz").startswith("Unknown pattern") and "src/lib/text.ts" in tools.search_code(index, "digest")
    assert "Imported by: src/main.ts" in tools.get_file_summary(index, "src/session.ts", 5000)
    assert "Test: none" in tools.get_smart_context(index, "src/main.ts") and "not indexed" in tools.get_smart_context(index, "zz")


def test_tools_on_an_empty_index(spark):
    from lodestone import tools
    from lodestone.schema import Index

    none = Index.empty(spark)
    assert "first run" in tools.get_changes_since_last_session(none)
    assert tools.get_project_map(none) == "Nothing is indexed"
    assert tools.find_unused_code(none) == "No unused code" and tools.find_unused_exports(none) == "No unused exports"
    assert tools.search_code(none, "x").startswith("Nothing found")


def test_sessions_and_increments(spark, project):
    root, store, _ = project
    config = conf.Config(exclude=["**/*.test.*"])
    first = store.start_session(1)
    store.end_session(first, 2)
    assert C.changes_since_last_session(store.read()).count() == 0
    assert counts(index_project(spark, root, store, 3, config)) == {"indexed": 0, "skipped": 9, "removed": 0, "errors": 0}
    store.start_session(4)  # an open session doesn't hide the closed one
    write(root, {"src/lib/text.ts": "export function digest() {}\nexport function added() {}\n", "src/new.ts": "export const N = 1\n"})
    os.remove(os.path.join(root, "lib/util.py"))
    assert counts(index_project(spark, root, store, 5, config)) == {"indexed": 2, "skipped": 7, "removed": 1, "errors": 0}
    index = store.read()
    told = {r["path"]: (r["change"], r["added"], r["removed"]) for r in C.changes_since_last_session(index).collect()}
    assert told == {"src/lib/text.ts": ("modified", ["added"], ["helper", "lonely"]), "src/new.ts": ("added", [], []), "lib/util.py": ("deleted", [], [])}
    assert index.symbols.where("name = 'load'").count() == 0
    assert index.idf.where("term = 'added'").count() == 1


def test_snapshots(spark):
    old = spark.createDataFrame([('{"a": "h1", "b": {"hash": "h2", "symbols": ["x"]}}',)], "file_snapshot string")
    now = spark.createDataFrame([("a", "h9", ["p"]), ("b", "h2", ["x"])], "path string, hash string, symbols array<string>")
    assert rows(C.changes(now, C.snapshot_rows(old)), "path", "change", "added", "removed") == [("a", "modified", ["p"], [])]
    with pytest.raises(Exception, match="corrupted snapshot"):
        C.snapshot_rows(spark.createDataFrame([("{oops",)], "file_snapshot string")).collect()


def test_config(tmp_path):
    assert conf.load_config(str(tmp_path)) == conf.Config()
    conf.init_config(str(tmp_path))
    with pytest.raises(FileExistsError):
        conf.init_config(str(tmp_path))
    (tmp_path / conf.CONFIG_NAME).write_text('{"include": [], "max_file_size": 5, "other": 1}')
    assert conf.load_config(str(tmp_path)).max_file_size == 5
    (tmp_path / "go.mod").write_text("module a.b/c\n")
    (tmp_path / "x/y").mkdir(parents=True)
    assert conf.project_root(str(tmp_path / "x/y")) == str(tmp_path.resolve())
    assert conf.encoded_path("/foo/bar") == "foo-bar" and conf.encoded_path("C:\\Users\\t") == "C-Users-t"
