"""Operator 13 against plain counting over every order."""

import random
from itertools import permutations

import pytest

from lodestone.llm import filter_audit
from tests.llm.test_operators import clash

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def fails(rows):
    """The set of filters that each row fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        out.append(bad)
    for k, (i, t, _) in enumerate(rows):
        if i is not None and least[t or ""] < i:
            out[k].add("E")
    return out


def brute(rows, labels):
    bad, out = fails(rows), {}
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    for part in {s or "" for _, _, s in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in bad[k]]
                before = [k for k in own if f in bad[k] and bad[k] & set(order[: step - 1])]
                left = [k for k in left if f not in bad[k]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(before), sum(bad[k] == {f} for k in own), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    rows = []
    for i in range(120):
        n = rng.choice([0, 3, 150, 199, 200, 240])
        pool = rng.choice([3, 60, 500])
        t = " ".join(rng.choice(["w%d", "W%d", "é%d"]) % rng.randrange(pool) for _ in range(n))
        rows.append((i, t + rng.choice(["", "", " #", "\x0bx|", " ÀÉ", " y"]), rng.choice(["s1", "s2", None, ""])))
    rows += [(200 + k, rows[k][1], "s1") for k in range(20)] + [(5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (300, None, "s1"), (301, None, None), (None, "a b", "s1"), (302, "a b", "s1"), (None, rows[7][1], "s1"), (303, "x " * 50_000, "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_every_order(spark, corpus):
    rows, labels = corpus
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(5))
    found = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in found}
    assert len(found) == len(got) and got == brute(rows, labels)


def test_many_parts_and_none(spark):
    rows = [(i, "x", f"p{i}") for i in range(1500)]
    found = filter_audit.audit(spark.createDataFrame(rows, DOCS).coalesce(1), spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD'")
    assert {(r["step"], r["removed"], r["count"]) for r in found.groupBy("step", "removed").count().collect()} >= {(1, 0, 1), (1, 1, 1499), (2, 1, 1)}
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
