"""License scan and decontamination against plain versions that look at every place."""

import math
import random

from lodestone.llm import decontaminate, license_scan
from lodestone.llm.words import plain_words
from tests.llm.conftest import prose


def grams(words, n):
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def edited(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), round(share * len(w))):
        w[i] = rng.choice(["qu", f"{w[i]} qu", ""])
    return " ".join(x for x in w if x)


def test_leaks_against_every_place(spark):
    rng = random.Random(41)
    items = [(i, prose(rng, rng.randint(3, 70))) for i in range(40)]
    docs = []
    for i, (_, t) in enumerate(items * 3):
        docs.append((i, f"{prose(rng, rng.randint(0, 40))} {edited(rng, t, rng.choice([0, 0, 0.02, 0.04, 0.1]))} {prose(rng, rng.randint(0, 40))}"))
    docs += [(1000 + i, prose(rng, 120)) for i in range(40)]
    plain = lambda t: [w.decode() for w in plain_words(t.encode())]
    shingles = {i: grams(plain(t), 5) for i, t in items}
    seen = {}
    for s in shingles.values():
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    weight = lambda g: math.log1p(len(items) / seen[g])
    want = set()
    for d, t in docs:
        w = plain(t)
        for i, s in shingles.items():
            n = len(plain(items[i][1]))
            reach = n + 2 * (n // 10 + 1)
            total = sum(map(weight, s))
            best = max(sum(weight(g) for g in s & grams(w[a : a + reach], len(next(iter(s))))) for a in range(max(1, len(w) - n + 1)))
            if best >= 0.8 * total - 1e-9:
                want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got <= want and len(want) > 60 and len(want & got) >= 0.97 * len(want), sorted(want - got)


def test_licenses_against_every_place(spark):
    rng = random.Random(42)
    names = sorted(license_scan.TEMPLATES)
    docs = []
    for i in range(60):
        docs.append((i, f"{prose(rng, rng.randint(0, 60))}\n{edited(rng, license_scan.TEMPLATES[names[i % len(names)]], rng.choice([0, 0, 0.01, 0.03]))}\n{prose(rng, rng.randint(0, 60))}"))
    docs += [(1000 + i, prose(rng, 200)) for i in range(20)]
    plain = lambda t: [w.decode() for w in plain_words(t.encode())]
    shingles = {n: grams(plain(license_scan.TEMPLATES[n]), 5) for n in names}
    size = {n: len(plain(license_scan.TEMPLATES[n])) for n in names}
    want = set()
    for d, t in docs:
        w = plain(t)
        for n, s in shingles.items():
            if any(len(s & grams(w[a : a + size[n]], 5)) >= 0.8 * len(s) for a in range(max(1, len(w) - size[n] + 1))):
                want.add((d, n))
    found = license_scan.find_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates=license_scan.TEMPLATES)
    got = {(r["doc_id"], r["license"]) for r in found.collect()}
    assert len(want) >= 40 and len(want & got) >= 0.97 * len(want), sorted(want - got)
    assert not {g for g in got - want if g[0] >= 1000}
