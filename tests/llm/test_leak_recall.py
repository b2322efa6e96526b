"""Leaks whose verdict must not depend on slices or strides."""

import random

import numpy as np

from lodestone.llm import decontaminate
from lodestone.llm.words import plain_words, word_hashes
from tests.llm.conftest import prose


def test_weights_do_not_depend_on_slices(spark, monkeypatch):
    rng = random.Random(31)
    stem = prose(rng, 12)
    items = [(i, f"{stem} {prose(rng, 12)}") for i in range(12)] + [(20 + i, prose(rng, 24)) for i in range(12)]
    docs = spark.createDataFrame([(i, f"{prose(rng, 30)} {t.rsplit(' ', 2 + i % 4)[0]} {prose(rng, 30)}") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda b: sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontaminate.find_leaks(docs, b, similarity=0.3).collect())
    whole = find(bench)
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 5)
    assert whole and find(bench) == whole and find(bench.orderBy("text")) == whole


def test_edited_copies_are_found():
    rng = random.Random(32)
    items = [prose(rng, rng.randint(15, 59)) for _ in range(150)]
    index = decontaminate.build_index([(i, t.encode()) for i, t in enumerate(items)])
    texts = []
    for i, t in enumerate(items):
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "qu"
            have = np.isin(index.shingles[i], decontaminate._shingles(word_hashes(plain_words(" ".join(w).encode()))))
            if index.weights[i][have].sum() >= 0.8 * index.weights[i].sum():
                texts.append((i, f"{prose(rng, rng.randint(0, 9))} {' '.join(w)} {prose(rng, 9)}".encode()))
    found = decontaminate.search(index, [t for _, t in texts], 0.8)
    assert len(texts) > 300 and sum(any(h[0] == i for h in hits) for (i, _), hits in zip(texts, found)) >= 0.998 * len(texts)
