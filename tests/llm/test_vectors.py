"""Operators 11 and 12 against all pairs, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, hard_negatives, vector_graph
from tests.llm.test_operators import clash

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int"


def cloud(rng, n, d=8, groups=6, copies=30):
    """Random vectors, tight and loose groups, scaled and equal copies."""
    rows = [rng.standard_normal(d) for _ in range(n)]
    for g in range(groups):
        middle = rng.standard_normal(d)
        rows += [middle + rng.standard_normal(d) * (0.05 if g % 2 else 0.25) for _ in range(copies)]
    rows += [rows[0]] * 12 + [rows[1] * k for k in (2.0, 3.0, 1e200, 1e-200)]
    return [[float(x) for x in v] for v in rows]


def cosine(a, b):
    a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
    return a @ b / math.sqrt((a @ a) * (b @ b))


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def all_links(rows, threshold=0.9):
    links = {k: [] for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            u, v = rows[a][1], rows[b][1]
            if good(u) and good(v) and len(u) == len(v) and cosine(u, v) >= threshold:
                links[a].append(b)
                links[b].append(a)
    return links


@pytest.mark.parametrize("limit", [2048, 24])
def test_links_against_all_pairs(spark, limit):
    vectors = cloud(np.random.default_rng(limit), 150)
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, None), (904, [NAN] * 8, 1), (905, [INF] + [1.0] * 7, 1), (906, vectors[0][:5], 1), (907, vectors[0][:5], 1), (3, vectors[3], 0), (None, vectors[5], 0), (None, [-0.0] * 7 + [1.0], 0)]
    found = embedding_dedup.near_vectors(clash(spark.createDataFrame(rows, SCHEMA)), cell_limit=limit, sample=64 if limit < 100 else 4096).collect()
    assert len(found) == len(rows)
    links = all_links(rows)
    least = vector_graph.roots(len(rows), *(np.array(x) for x in zip(*[(a, b) for a in links for b in links[a]])))
    ids = {}
    for k, root in enumerate(least):
        if rows[k][0] is not None:
            ids[root] = min(ids.get(root, rows[k][0]), rows[k][0])
    want = sorted((str(r[0]), len(links[k]), str(ids.get(least[k])), r[0] == ids.get(least[k])) for k, r in enumerate(rows))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found)
    true, there = sum(w[1] for w in want), sum(g[1] for g in got)
    assert there <= true and there >= 0.97 * true
    if limit > 100:
        assert got == want
    assert found[0]["audited_recall"] >= 0.9


def test_scaled_copies_are_parted_by_hash_and_linked(spark):
    """K-means can't part vectors of one direction; every part is searched."""
    rows = [(i, [3.0 + i, 0.0, (3.0 + i) / 2], 0) for i in range(90)] + [(500 + i, [0.0, 1.0 + i, 0.0], 0) for i in range(3)]
    found = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), cell_limit=16, sample=64).collect()}
    assert all(found[i]["n_links"] == 89 and found[i]["component_id"] == 0 for i in range(90))
    assert [found[500 + i]["n_links"] for i in range(3)] == [2, 2, 2]


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = embedding_dedup.near_vectors(spark.createDataFrame([(1, [0.5], 1)], SCHEMA)).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lone] == [(1, 0, 1, True)]


def test_pruning_keeps_the_nearest_and_bounds_the_degree():
    units = vector_graph.unit(np.random.default_rng(3).standard_normal((400, 6)))
    near = vector_graph.build(units, 1)
    assert near.shape[1] == vector_graph.DEGREE + 4
    sims = units @ units.T
    np.fill_diagonal(sims, -2)
    assert (near == sims.argmax(axis=1)[:, None]).any(axis=1).mean() > 0.99
    assert all((row[row >= 0] != k).all() for k, row in enumerate(near))


def test_recall_is_audited(spark, monkeypatch):
    """A search that meets little is built again, and then fails."""
    rows = [(i, v, 0) for i, v in enumerate(cloud(np.random.default_rng(5), 10))]
    tried = []

    def searched(nodes, **options):
        tried.append((options["overlap"], options["beam"]))
        return nodes.select("node", F.lit(0).cast("long").alias("n")).limit(0), nodes.selectExpr("node a", "node b").limit(0)

    monkeypatch.setattr(embedding_dedup, "_searched", searched)
    with pytest.raises(RuntimeError, match="audited"):
        embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))
    assert tried == [(2, 16), (3, 32), (4, 64)]


def negatives(rows, positives=5, k=5):
    """Brute force of the mining rule: full sorts of plain integers."""
    part = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((i, [math.floor(256 * x) for x in v], label))
    out, seen = [], set()
    for a in part:
        if a[0] % 10 or (a[0], a[2], tuple(a[1])) in seen:
            continue
        seen.add((a[0], a[2], tuple(a[1])))
        scored = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in part if b[0] != a[0] and len(b[1]) == len(a[1]))
        for s, p, _ in [x for x in scored if x[2] == a[2]][:positives]:
            fits = [(n, t) for t, n, label in scored if label != a[2] and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a[0], p, r + 1, n, -s, -t) for r, (n, t) in enumerate(fits[:k])]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(8192, 1024), (37, 3)])
def test_negatives_against_full_sorts(spark, tiles):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(4), 1)], int(rng.integers(0, 3)) if rng.random() < 0.7 else 0) for i in range(260)]
    rows += [(300, None, 1), (310, [1.0, None, 0.0, 0.0], 1), (320, [1.0, NAN, 0.0, 0.0], 1), (330, [1.0, 0.0, 0.0, -INF], 1), (340, [1.0] * 4, None), (None, [1.0] * 4, 1), (350, [1.0, 2.0], 0), (351, [1.0, 2.5], 0), (352, [1.0, 2.0], 1), (360, [], 1), (370, [1e6, 1e6, 1.0, 0.0], 1), (371, [1e6, 1e6, 1.5, 0.0], 1), (372, [1e6, 1e6, 1.25, 0.0], 2)]
    found = hard_negatives.hard_negatives(clash(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 10 == 0, tile_rows=tiles[0], tile_anchors=tiles[1]).collect()
    assert sorted(map(tuple, found)) == negatives(rows)
    assert found[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_few_negatives_and_ties(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.9, 0.0], 1), (5, [0.1, 0.0], 1), (6, [2.0, 0.0], 1), (0, [1.0, 0.0], 0), (10, [-1.0, 0.0], 2), (11, [1.0, 0.0], 2)]
    found = sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()))
    assert found == negatives(rows)
    assert [r[3] for r in found if r[:2] == (0, 1)] == [2, 3, 11, 4]  # equal scores by id, none above the positive's
    assert not [r for r in found if r[0] == 10]  # no score is between a negative limit and its 80 %
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[float(2**40), 3.0]]), np.array([[float(2**20), 1.0], [float(2**20), 2.0]])
    assert hard_negatives._scores(a, b).tolist() == [[2**60 + 3, 2**60 + 6]]
