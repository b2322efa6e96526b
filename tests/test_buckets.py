"""The bucketed store: what a change rewrites, weights by deltas, and failed writes."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators.search import inverse_frequencies
from lodestone.plans.index import index_project
from lodestone.sources import store as stores
from lodestone.sources.store import PER_FILE, Store
from tests.test_project import write

FILES = {f"src/m{k}.py": f"from .m{(k + 1) % 6} import f{(k + 1) % 6}\n\n\ndef f{k}():\n    word{k % 3} = shared = f{(k + 1) % 6}()\n" for k in range(6)}


def rows(index, table):
    return sorted(map(repr, getattr(index, table).drop("indexed_at", "mtime").collect()))


def weights(store):
    return {r["term"]: round(r["idf"], 9) for r in store.read().idf.collect()}


def full_weights(index):
    return {r["term"]: round(r["idf"], 9) for r in inverse_frequencies(index.tfidf, index.files.count()).collect()}


@pytest.fixture
def project(spark, tmp_path):
    root, store = str(tmp_path / "tree"), Store(spark, f"file://{tmp_path}/store", buckets=5)
    write(root, FILES)
    assert index_project(spark, root, store, 1)["indexed"] == 6
    return root, store


def test_a_change_rewrites_its_buckets_only(spark, tmp_path, project):
    root, store = project
    before = store.meta()["at"]
    write(root, {"src/m2.py": "def g2():\n    return rare\n"})
    os.utime(f"{root}/src/m2.py", (9, 9))
    told = index_project(spark, root, store, 2)
    assert {k: told[k] for k in ("indexed", "skipped", "removed", "errors")} == {"indexed": 1, "skipped": 5, "removed": 0, "errors": 0}
    after, version = store.meta()["at"], store.meta()["version"]
    (mine,) = (r[0] for r in spark.range(1).select(store.bucket(F.xxhash64(F.lit("src/m2.py")))).collect())
    for table in PER_FILE:
        moved = {b for b in {*before[table], *after[table]} if before[table].get(b) != after[table].get(b)}
        assert moved <= {str(mine)} and all(after[table][b] == version for b in moved if b in after[table])
        written = [n for n in os.listdir(tmp_path / "store" / version / table) if n.startswith("bucket=")]
        assert set(written) <= {f"bucket={mine}"}
    fresh = Store(spark, f"file://{tmp_path}/other", buckets=3)
    index_project(spark, root, fresh, 2)
    for table in PER_FILE:
        assert rows(store.read(), table) == rows(fresh.read(), table), table


def test_weights_by_deltas_equal_a_full_count(spark, project):
    root, store = project
    assert weights(store) == full_weights(store.read())
    write(root, {"src/m2.py": "def g2():\n    return rare\n", "src/m9.py": "def added(): pass\n"})
    os.utime(f"{root}/src/m2.py", (9, 9))
    os.remove(f"{root}/src/m0.py")
    index_project(spark, root, store, 2)
    found = weights(store)
    assert found == full_weights(store.read()) and "rare" in found


def test_stale_weights_catch_up(spark, project):
    root, store = project
    old = weights(store)
    write(root, {"src/m7.py": "def seven(): pass\n"})
    index_project(spark, root, store, 2, refresh_idf=False)
    os.remove(f"{root}/src/m1.py")
    index_project(spark, root, store, 3, refresh_idf=False)
    assert weights(store) == old and len(store.meta()["pending"]) == 2
    index_project(spark, root, store, 4)  # nothing changed; the weights follow
    assert weights(store) == full_weights(store.read()) and not store.meta()["pending"]


def test_only_changed_files_terms_are_read(spark, project, monkeypatch):
    root, store = project
    read, asked = store.read, []
    monkeypatch.setattr(store, "read", lambda buckets=None: asked.append(buckets) or read(buckets))
    write(root, {"src/m3.py": "def three(): pass\n"})
    os.utime(f"{root}/src/m3.py", (9, 9))
    index_project(spark, root, store, 2)
    assert asked[0] is None and len(asked[1]) == 1 and len(asked) == 2  # the table of files, then one bucket
    assert all("bucket=" in f for f in read([1]).tfidf.inputFiles())


def test_a_failed_write_leaves_the_old_version(spark, project, monkeypatch):
    root, store = project
    before, found = rows(store.read(), "symbols"), weights(store)
    write(root, {"src/m4.py": "def four(): pass\n"})
    os.utime(f"{root}/src/m4.py", (9, 9))

    def broken(**values):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(store, "set_meta", broken)
        with pytest.raises(OSError):
            index_project(spark, root, store, 2)
    assert rows(store.read(), "symbols") == before and weights(store) == found
    assert index_project(spark, root, store, 3)["indexed"] == 1 and "four" in {r["name"] for r in store.read().symbols.collect()}


def test_deltas_are_folded(spark, tmp_path, project, monkeypatch):
    root, store = project
    monkeypatch.setattr(stores, "FOLD", 1)
    for k in range(2):
        write(root, {f"src/n{k}.py": f"def new{k}(): pass\n"})
        index_project(spark, root, store, 2 + k)
    assert len(store.meta()["counted"]) == 1 and weights(store) == full_weights(store.read())
    kept = {n for n in os.listdir(tmp_path / "store") if n.startswith("v-")}
    used = {v for t in store.meta()["at"].values() for v in t.values()} | set(store.meta()["counted"])
    assert used <= kept and len(kept - used) <= stores.KEEP + 1


def test_counts_are_observed(spark, project):
    """One pass tells what was indexed, touched, removed and failed."""
    root, store = project
    write(root, {"src/m0.py": FILES["src/m0.py"], "src/bad.py": "def bad(): pass\n", "src/m1.py": "def one(): pass\n"})
    for k, name in enumerate(("m0", "m1")):
        os.utime(f"{root}/src/{name}.py", (50 + k, 50 + k))
    os.remove(f"{root}/src/m5.py")
    told = index_project(spark, root, store, 5)
    assert {k: told[k] for k in ("indexed", "skipped", "removed", "errors")} == {"indexed": 2, "skipped": 4, "removed": 1, "errors": 0}
    assert {r["path"]: r["mtime"] for r in store.read().files.collect()}["src/m0.py"] == 50_000
