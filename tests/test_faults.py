"""Unfinished files, failing extractors, switching projects, watching a tree."""

import os
import time

from pyspark.sql import functions as F

from lodestone import tools
from lodestone.extract import EXTRACTORS, extract
from lodestone.operators import context as X
from lodestone.plans.index import apply_events, index_project
from lodestone.project import Project
from lodestone.sources import config as conf
from lodestone.sources.store import KEEP, Store
from lodestone.streaming.events import watch
from lodestone.sources.tree import tree_events
from tests.test_project import FILES, write

UNFINISHED = {
    "typescript": "export {a} from 'x'\nexport default function f(a) { return g(a) }\nimport * as q from './q'\nenum E { A }\n",
    "java": "package a.b;\nimport static java.util.List.of;\npublic class A { void f() { g(); } }\n",
    "c_sharp": "using System;\nusing X = A.B;\nnamespace N { public class A { int P { get; } public delegate int D(int x); } }\n",
    "go": "package a\nimport (\n \"fmt\"\n)\ntype T struct{}\nfunc (t *T) F() { fmt.Println() }\nconst (\n A = 1\n)\n",
    "rust": "use a::{b, c};\npub(crate) fn f() { g() }\nimpl X for Y { fn h(&self) {} }\nmod m { }\n",
    "python": "import os\nfrom .a import b\nclass A:\n    def f(self):\n        return g()\n",
}


def test_unfinished_files_are_read_as_far_as_they_go():
    for language, text in UNFINISHED.items():
        for k in range(len(text) + 1):
            for part in (text[:k], text[k:]):
                found = extract(language, part)
                assert set(found) == {"symbols", "imports", "exports", "calls", "refs"}


def test_one_failing_file_stops_no_other(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "tree"), Store(spark, f"file://{tmp_path}/store")
    write(root, {"src/a.py": "def a(): pass\n", "src/b.py": "def b(): pass\n", "src/bin/main.rs": "fn main() {}\n", "src/logs/l.py": "def l(): pass\n", "target/x.rs": "fn gone() {}\n"})
    config = conf.Config(include=[])
    assert index_project(spark, root, store, 1, config)["indexed"] == 4
    assert {r["path"] for r in store.read().files.collect()} == {"src/a.py", "src/b.py", "src/bin/main.rs", "src/logs/l.py"}
    write(root, {"src/a.py": "def a2(): pass\n", "src/b.py": "def b2(): pass\nfail\n"})
    for name in ("a", "b"):
        os.utime(f"{root}/src/{name}.py", (9, 9))
    good = EXTRACTORS["python"]

    def failing(text):
        if "fail" in text:
            raise RecursionError("too deep")
        return good(text)

    monkeypatch.setitem(EXTRACTORS, "python", failing)
    from lodestone.plans import index as plan

    monkeypatch.setattr(plan, "extract", lambda lang, text: {"symbols": [], "imports": [], "exports": [], "calls": [], "refs": [], **(failing(text) if lang == "python" else EXTRACTORS[lang](text))})
    told = index_project(spark, root, store, 2, config)
    assert (told["indexed"], told["errors"], told["skipped"]) == (1, 1, 2)
    assert {r["name"] for r in store.read().symbols.collect()} == {"a2", "b", "main", "l"}
    assert index_project(spark, root, store, 3, config)["errors"] == 1  # tried again


def test_doc_above_an_indented_symbol(spark):
    text = "class A {\n\t// says what\n\t// it does\n\tvoid f() {}\n  x\n}"
    (row,) = spark.createDataFrame([(text,)], "c string").select(X.doc_start(F.col("c"), F.lit(4)).alias("n")).collect()
    assert row["n"] == 2


def test_projects_are_switched_and_read_again(spark, tmp_path):
    for name in ("one", "two"):
        write(str(tmp_path / name), {**FILES, "package.json": "{}"})
    project, told = tools.set_project(None, spark, str(tmp_path / "one" / "src"), 1000, "local")
    assert project.root == str(tmp_path / "one") and "9 indexed" in told or "10 indexed" in told
    same, told = tools.set_project(project, spark, str(tmp_path / "one"), 1100, "local")
    assert same is project and "already" in told
    assert tools.reindex(project, str(tmp_path / "one" / "src/main.ts")) == "Re-indexed: src/main.ts"
    assert "unchanged, 0 removed, 0 failed" in tools.reindex(project) and tools.reindex(project, "src/none.ts") == "No changes: src/none.ts"
    other, told = tools.set_project(project, spark, str(tmp_path / "two"), 2000, "local")
    assert other.root == str(tmp_path / "two") and other is not project
    assert project.store.read().sessions.where("ended_at = 2000 and file_snapshot is not null").count() == 1
    again = Project.open(spark, project.root, 3000, "local")
    assert again.counts["indexed"] == 0 and "(1970-01-01T00:00:02.000Z)" in tools.get_changes_since_last_session(again.store.read())
    assert tools.set_project(None, spark, str(tmp_path / "none"), 1, "local")[0] is None
    versions = [n for n in os.listdir(tmp_path / "one/.lodestone/tables") if n.startswith("v-")]
    assert len(versions) <= KEEP + 10 and len([n for n in os.listdir(tmp_path / "one/.lodestone/tables") if n.startswith("CURRENT-")]) <= KEEP + 1


def test_a_tree_is_watched(spark, tmp_path):
    root, store = str(tmp_path / "tree"), Store(spark, f"file://{tmp_path}/store")
    write(root, {"src/a.py": "def a(): pass\n", "src/b.py": "def b(): pass\n"})
    index_project(spark, root, store, 1)
    batches = []
    apply = apply_events(spark, root, store, 2)

    def seen(batch, batch_id):
        batches.append(sorted((r["path"], r["event"]) for r in batch.collect()))
        apply(batch, batch_id)

    query = watch(tree_events(spark, root, str(tmp_path / "state"), 200), seen, f"file://{tmp_path}/checkpoint", "100 milliseconds")
    until = time.time() + 60
    try:
        while not batches and time.time() < until:
            time.sleep(0.1)
        write(root, {"src/a.py": "def a3(): pass\n", "src/c.py": "def c(): pass\n"})
        os.utime(f"{root}/src/a.py", (9, 9))
        os.remove(f"{root}/src/b.py")
        while {r["name"] for r in store.read().symbols.collect()} != {"a3", "c"} and time.time() < until:
            time.sleep(0.3)
    finally:
        query.stop()
    assert {r["name"] for r in store.read().symbols.collect()} == {"a3", "c"}
    assert batches[0] == [("src/a.py", "add"), ("src/b.py", "add")]
    assert sorted(x for b in batches[1:] for x in b) == [("src/a.py", "change"), ("src/b.py", "unlink"), ("src/c.py", "add")]
