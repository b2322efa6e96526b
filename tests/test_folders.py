"""Differences by folder digests against the plain comparison."""

import random

from lodestone.operators import folders
from lodestone.operators.changes import changes

STATE = "path string, hash string, symbols array<string>"


def state(rng, n):
    made = {}
    for k in range(n):
        depth = rng.randint(0, 4)
        made["/".join([rng.choice("abc") for _ in range(depth)] + [f"f{k % 40}"])] = (str(rng.randint(0, 9)), rng.choice([None, [], ["x"], ["x", "y"]]))
    return made | {"": ("1", []), "/": ("1", []), "/top": ("1", None), "a//b": ("2", ["z"])}


def frame(spark, made):
    return spark.createDataFrame([(p, h, s) for p, (h, s) in made.items()], STATE)


def test_the_same_rows_as_a_plain_comparison(spark):
    rng = random.Random(6)
    before = state(rng, 150)
    now = dict(before)
    for p in rng.sample(sorted(now), 6):
        del now[p]
    for p in rng.sample(sorted(now), 6):
        now[p] = ("changed", ["new"])
    now |= {"q/r/s/new": ("1", []), "rootfile": ("1", ["r"]), "a/b/c/only": ("1", [])}
    new, old = frame(spark, now), frame(spark, before)
    assert folders.changes_by_folder(new, old).collect() == changes(new, old).collect()
    assert folders.changes_by_folder(old, old).count() == 0
    assert folders.changes_by_folder(new, old.limit(0)).collect() == changes(new, old.limit(0)).collect()


def test_equal_subtrees_are_not_entered(spark):
    before = {f"{a}/{b}/f": ("1", []) for a in "abcd" for b in "xyz"}
    now = before | {"b/y/f": ("2", [])}
    found = folders.differing_folders(folders.folder_digests(frame(spark, now)), folders.folder_digests(frame(spark, before)))
    assert sorted((r["folder"], r["level"]) for r in found.collect()) == [("", 0), ("/b", 1), ("/b/y", 2)]
