"""Operator 5's network against plain loops over passages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_classifier as Q
from tests.llm.conftest import prose


def score(w, bag):
    """Gated attention over one document's passages, number by number."""
    dot = lambda x, m, j: sum(float(x[i]) * float(m[i][j]) for i in range(len(x)))
    hidden = [[math.tanh(dot(x, w["W"], j) + float(w["b"][j])) for j in range(len(w["b"]))] for x in bag]
    raw = []
    for h in hidden:
        gates = [math.tanh(dot(h, w["V"], k)) / (1 + math.exp(-dot(h, w["U"], k))) for k in range(len(w["w"]))]
        raw.append(sum(g * float(a) for g, a in zip(gates, w["w"])))
    top = max(raw)
    shares = [math.exp(r - top) for r in raw]
    pooled = [sum(s * h[j] for s, h in zip(shares, hidden)) / sum(shares) for j in range(len(w["c"]))]
    return 1 / (1 + math.exp(-(sum(z * float(c) for z, c in zip(pooled, w["c"])) + float(w["d"][0]))))


def test_forward_is_the_loop():
    rng = np.random.default_rng(4)
    w = {k: rng.standard_normal(s) for k, s in {"W": (6, 5), "b": (5,), "V": (5, 4), "U": (5, 4), "w": (4,), "c": (5,), "d": (1,)}.items()}
    counts = np.array([1, 4, 2, 7])
    x = rng.standard_normal((counts.sum(), 6))
    first = np.cumsum(counts) - counts
    got = Q._forward(w, x, first, np.repeat(np.arange(4), counts))["p"].ravel()
    assert got == pytest.approx([score(w, x[s : s + n]) for s, n in zip(first, counts)], abs=1e-9)


def test_features_do_not_depend_on_the_batch():
    texts = [b"a b", b"", None, b" \n ", "\u00e9 x".encode(), b"#" * 500, b"w " * 300, b"", b"end"]
    whole, bags = Q.encode(texts)
    for k, (first, n) in enumerate(zip(np.cumsum(bags) - bags, bags)):
        assert np.array_equal(Q.encode([texts[k]])[0], whole[first : first + n])


def test_query_scores_are_the_loop(spark):
    """Scores of whole documents, from the model's own passages."""
    rng = np.random.default_rng(7)
    import random

    r = random.Random(3)
    rows = [(i, prose(r, r.randint(5, 400)) if i % 3 else " ".join(["#x$"] * r.randint(5, 400))) for i in range(60)] + [(60, ""), (61, None), (62, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    model = Q.train(docs, labels, F.lit(True))
    found = {x["doc_id"]: x["score"] for x in Q.classify(docs, model).collect()}
    for i in [*rng.choice(60, 6, replace=False).tolist(), 60, 61, 62]:
        x, _ = Q.encode([(rows[i][1] or "").encode()])
        scaled = np.clip((x - model.mean) / model.scale, -8, 8).astype(np.float32)
        assert found[i] == pytest.approx(score(model.weights, scaled), abs=1e-4)
