"""Listings and event streams by partitions, and bursts as keyed state."""

import os
import time

import pytest

from lodestone.sources.tree import TreeStream, listing, tree_events, walked
from lodestone.streaming.events import watch
from lodestone.streaming.keyed import followed
from tests.test_project import write

TREE = {**{f"pkg{k % 3}/sub{k % 5}/deep/f{k}.py": "x" * k for k in range(40)}, "top.py": "a", "pkg0/near.py": "bb", "pkg1/node_modules/lib/no.js": "", "node_modules/a.js": "", ".git/x.py": "", "pkg2/.hidden.py": ""}


def shown(tree):
    return {p: len(t) for p, t in tree.items() if "node_modules" not in p and not any(x.startswith(".") for x in p.split("/"))}


def test_partitions_share_the_tree(spark, tmp_path):
    write(str(tmp_path), TREE)
    parts = [[p for p, _, _ in walked(str(tmp_path), k, 4)] for k in range(4)]
    assert sorted(sum(parts, [])) == sorted(shown(TREE)) and sum(map(bool, parts)) > 1
    rows = listing(spark, str(tmp_path), 4)
    assert {r["path"]: r["length"] for r in rows.collect()} == shown(TREE) and rows.rdd.getNumPartitions() == 4
    assert all(r["mtime"] == os.stat(tmp_path / r["path"]).st_mtime_ns // 1_000_000 for r in rows.collect())
    assert listing(spark, str(tmp_path / "none"), 4).count() == 0


def test_a_trigger_is_run_again_as_it_was(tmp_path):
    root, options = str(tmp_path / "tree"), {"root": str(tmp_path / "tree"), "state": str(tmp_path / "state"), "partitions": "3"}
    write(root, TREE)
    ahead = time.time_ns() // 1_000_000 + 10_000

    def told(start, end):
        stream = TreeStream(options)  # as after a restart
        return sorted((p, e) for share in stream.partitions({"ms": start}, {"ms": end}) for p, e, _, _ in stream.read(share))

    assert told(0, ahead) == sorted((p, "add") for p in shown(TREE))
    os.remove(f"{root}/top.py")
    write(root, {"pkg9/new.py": "", "pkg0/near.py": "longer"})
    os.utime(f"{root}/pkg0/near.py", (5, 5))
    assert told(0, ahead) == sorted((p, "add") for p in shown(TREE))
    change = [("pkg0/near.py", "change"), ("pkg9/new.py", "add"), ("top.py", "unlink")]
    assert told(ahead, ahead + 1) == change
    write(root, {"later.py": ""})
    assert told(ahead, ahead + 1) == change and told(ahead + 1, ahead + 2) == [("later.py", "add")]


def test_a_file_still_written_to_waits(tmp_path):
    root = str(tmp_path / "tree")
    write(root, {"a.py": "1"})
    stream = TreeStream({"root": root, "state": str(tmp_path / "state"), "partitions": "1", "quiet_ms": "5000"})
    now = time.time_ns() // 1_000_000
    read = lambda a, b: [(p, e) for p, e, _, _ in stream.read(stream.partitions({"ms": a}, {"ms": b})[0])]
    assert read(0, now) == [] and read(now, now + 60_000) == [("a.py", "add")]


@pytest.mark.parametrize("events, told", [(["add", "change"], "add"), (["add", "unlink"], "unlink"), (["unlink", "add"], "add"), (["unlink", "change"], "change"), (["change", "change"], "change"), (["add", "unlink", "change"], "change")])
def test_bursts_amount_to_one_event(events, told):
    seen = None
    for e in events:
        seen = followed(seen, e)
    assert seen == told


def feed(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as out:
        out.writelines(f"{p},{e},2024-01-01 00:00:00,{s}\n" for p, e, s in rows)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.csv")


def until(done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)


def test_a_burst_lasts_over_batches_and_a_restart(spark, tmp_path):
    folder, seen, runs = str(tmp_path / "in"), [], []
    feed(folder, "one", [("a", "add", 1), ("b", "unlink", 2), ("c", "add", 3), ("c", "unlink", 4)])
    events = spark.readStream.schema("path string, event string, ts timestamp, seq long").csv(folder)

    def start(gap_ms):
        def apply(batch, batch_id):
            seen.append(sorted((r["path"], r["event"]) for r in batch.collect()))

        query = watch(events, apply, f"file://{tmp_path}/ck", "100 milliseconds", gap_ms=gap_ms)
        runs.append(query)
        return query

    try:
        first = start(45_000)
        until(lambda: any(p.numInputRows for p in first.recentProgress))
        first.stop()
        assert not seen  # held back: the gap has not passed
        feed(folder, "two", [("a", "change", 5), ("b", "add", 6)])
        second = start(3_000)
        until(lambda: sum(map(len, seen)) >= 3)
        second.stop()
        assert sorted(x for b in seen for x in b) == [("a", "add"), ("b", "add"), ("c", "unlink")]
    finally:
        for query in runs:
            query.stop()
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")  # the session's own setting is back


def test_a_watched_tree_gives_bursts(spark, tmp_path):
    root, seen = str(tmp_path / "tree"), []
    write(root, {"a.py": "", "b.py": ""})
    for name in ("a.py", "b.py"):
        os.utime(f"{root}/{name}", (5, 5))
    query = watch(tree_events(spark, root, str(tmp_path / "state"), 50, 2), lambda df, i: seen.extend((r["path"], r["event"]) for r in df.collect()), f"file://{tmp_path}/ck", "100 milliseconds", gap_ms=1500)
    try:
        until(lambda: len(seen) >= 2)
        os.remove(f"{root}/a.py")
        until(lambda: len(seen) >= 3)
    finally:
        query.stop()
    assert sorted(seen[:2]) == [("a.py", "add"), ("b.py", "add")] and seen[2:] == [("a.py", "unlink")]
