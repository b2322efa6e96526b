"""Every operator against a plain version, and its edge cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_id, license_scan, line_dedup, mixing, quality_classifier, quality_rules, simhash_dedup, substring_dedup, token_counts
from lodestone.llm.components import connected_components
from tests.llm import brute
from tests.llm.conftest import prose


def clash(df):
    """The same rows with columns named like the operators' own."""
    for name in ("id", "h", "size", "rank", "k", "fp", "line", "row", "bucket", "words"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (None, 4)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{k: 20 for k in range(20, 26)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules(docs, texts, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(clash(docs)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
        assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(clash(docs))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]} and kept.columns == clash(docs).columns
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_on_repeats(spark):
    rows = [(1, "a b c a b c x"), (2, "a a a a"), (3, "x y\nx y\n\n \nx y"), (4, "###" * 60), (5, "THE OF " * 60)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, t in rows:
        assert got[i]["n_repeat_words"] == brute.quality(t)[4] and got[i]["n_dup_lines"] == brute.quality(t)[3]
        assert not got[i]["kept"]


@pytest.mark.parametrize("limit", [4096, 2])
def test_near_duplicates(docs, texts, empty, limit):
    got = {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash_dedup.near_duplicates(clash(docs), bucket_limit=limit).collect()}
    assert got == brute.components(list(enumerate(texts)))
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_covering_masks_meet_every_pair():
    masks = simhash_dedup.covering_masks(3)
    rng = random.Random(0)
    for _ in range(3000):
        flipped = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not flipped & m for m in masks)


def test_keep_one(docs, texts, spark):
    groups = brute.components(list(enumerate(texts)))
    kept = simhash_dedup.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in groups.values()}) and kept.columns == docs.columns
    odd = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "other words are here now"), (5, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash_dedup.keep_one(odd).collect()) == [(5, "a b c d"), (5, "other words are here now")]


def test_substring(docs, texts, empty, spark):
    got = substring_dedup.remove_repeats(clash(docs), with_text=False)
    assert sorted(map(tuple, got.collect())) == sorted(brute.substring(list(enumerate(texts))))
    assert substring_dedup.remove_repeats(empty).count() == 0
    rng = random.Random(1)
    a = prose(rng, 40)
    odd = [(None, a), (3, a), (3, a), (2, a + " more"), (7, " ".join(a.split()[5:18])), (8, " ".join(a.split()[5:17]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(odd, "doc_id long, text string"), with_text=False)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute.substring(odd), key=key)


def test_substring_keeps_text(spark):
    rng = random.Random(2)
    a, b = prose(rng, 30), prose(rng, 20)
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, a), (2, f"{b} {a}")], "doc_id long, text string")).collect()}
    assert got == {1: a, 2: b}


def test_mixing(docs, texts, empty):
    got = mixing.mix_counts(clash(docs), block_words=16).collect()
    source = {i: ("s1", "s0", None, "s2")[i % 4] for i in range(len(texts))}
    sizes = {}
    for i, t in enumerate(texts):
        sizes[source[i]] = sizes.get(source[i], 0) + len(brute.words(t))
    want, taken = brute.targets(sizes), {}
    assert len(got) == len(texts)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(brute.words(texts[r["doc_id"]])) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_counts(docs.repartition(3), block_words=16).collect()))
    assert mixing.mix_counts(empty).count() == 0


def test_mix_blocks_hold_what_is_counted(docs, texts):
    parts = mixing.mix_blocks(docs, block_words=16, shard_blocks=8).collect()
    taken = {}
    for r in parts:
        w = brute.words(texts[r["doc_id"]])
        assert r["text"].split(" ") == w[r["first_word"] : r["first_word"] + r["n_words"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["n_words"]
    counted = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs, block_words=16, shard_blocks=8).collect() if r["taken"]}
    assert taken == counted
    assert len({r["shard"] for r in parts}) > 3


def test_shard_counts_decide_the_mix(spark):
    rows = [("a", 5000), ("b", 333), (None, 16), ("c", 0), ("d", 1)]
    sources = mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).cache()
    counts = mixing.shard_counts(sources, 16, 8).cache()
    drawn, given = counts.collect(), {r["rank"]: r for r in sources.collect()}
    found = mixing.slots(counts, 16).collect()
    per = {}
    for r in found:
        per[r["rank"], r["shard"]] = per.get((r["rank"], r["shard"]), 0) + 1
        assert 0 <= r["take"] <= 16 and 0 <= r["block"] < -(-given[r["rank"]]["source_size"] // 16)
    assert per == {(r["rank"], r["shard"]): r["n"] for r in drawn}
    for rank, s in given.items():
        assert sum(r["take"] for r in found if r["rank"] == rank) == round(s["target"])
    whole = [r for r in found if r["pass"] == 0 and r["rank"] == 1]
    assert len({r["block"] for r in whole}) == len(whole) and len({r["shard"] for r in drawn}) > 20
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mixing.shard_counts(sources.repartition(3), 16, 8).collect()))


def test_another_draw_is_another_mix(docs, texts):
    """Other counts of the shards take other words; each draw keeps targets and bounds."""
    mixes = []
    for blocks, seed in ((4, 7), (9, 7), (4, 8)):
        got = mixing.mix_counts(docs, block_words=16, shard_blocks=blocks, seed=seed).collect()
        assert all(r["taken"] <= 2 * r["size"] for r in got)
        per = {}
        for r in got:
            key = (r["source_size"], r["target"])
            per[key] = per.get(key, 0) + r["taken"]
        assert all(abs(n - key[1]) <= 0.5 for key, n in per.items())
        mixes.append({r["doc_id"]: r["taken"] for r in got})
    assert mixes[0] != mixes[1] and mixes[0] != mixes[2]


def test_shards_take_what_they_drew(spark):
    """From the same permutation, shards that draw more of a source take more of their stripe."""
    sources = mixing.source_targets(spark.createDataFrame([("a", 9000), ("b", 4000)], "source string, size long"))
    counts = mixing.shard_counts(sources, 16, 8).collect()
    assert len({r["n"] - r["places"] for r in counts if r["rank"] == 2}) > 2
    found = mixing.slots(mixing.shard_counts(sources, 16, 8), 16).collect()
    for r in counts:
        own = [x for x in found if (x["rank"], x["shard"]) == (r["rank"], r["shard"])]
        assert {x["place"] for x in own} == {r["first"] + j % r["places"] for j in range(r["n"])} and r["n"] <= 2 * r["places"]
        assert all(max(0, r["n"] // r["places"]) <= [x["place"] for x in own].count(p) <= -(-r["n"] // r["places"]) for p in range(r["first"], r["first"] + r["places"]))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select("id", mixing._swap_or_not(F.col("id"), F.lit(n).cast("long"), F.lit(3), 7).alias("to"))
        back = df.select("id", "to", mixing._swap_or_not(F.col("to"), F.lit(n).cast("long"), F.lit(3), 7, back=True).alias("again")).collect()
        assert {r["to"] for r in back} == set(range(n)) and all(r["again"] == r["id"] for r in back)


@pytest.mark.parametrize("skewed", [[10, 10, 10], [1, 100, 5], [0, 3, 9], [0, 0, 0]])
def test_targets(spark, skewed):
    rows = [(s, n) for s, n in zip(("b", None, "a"), skewed)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute.targets(dict(rows)) if sum(skewed) else dict.fromkeys(("a", "b", None), 0.0)
    assert got == pytest.approx(want)


def test_lines(spark, empty):
    rng = random.Random(3)
    a, b, c = (prose(rng, 14) for _ in range(3))
    edited = a[:-3] + "zzz"
    rows = [(1, f"{a}\n{b}"), (2, f"{a.upper()}!\n\n{c}"), (3, f"{edited}\n###\n{c} 12"), (4, None), (5, ""), (6, f"{a}\n{b}"), (6, f"{a}\n{b}")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = line_dedup.dedup_lines(df)
    kept = sorted((r["doc_id"], r["text"], r["_n_removed"]) for r in got.where("doc_id <> 4").collect())
    linked = brute.edit_similarity(a.split(), edited.split()) >= 0.8
    first = {r["doc_id"]: r["text"] for r in got.collect()}
    assert first[1] == f"{a}\n{b}" and first[2] == f"\n{c}" and first[4] is None and linked
    assert [k for k in kept if k[0] == 6] == [(6, "", 2), (6, "", 2)]
    assert first[3] == "###"
    assert line_dedup.dedup_lines(empty).count() == 0
    named = df.withColumn("_n_lines", F.lit("own")).withColumn("_n_removed", F.lit("own"))
    assert sorted((r["doc_id"], r["_n_removed"]) for r in line_dedup.dedup_lines(named).collect()) == sorted((r["doc_id"], r["_n_removed"]) for r in got.collect())
    left = line_dedup.keep_first_lines(named)
    assert left.columns == named.columns and {r["_n_lines"] for r in left.collect()} == {"own"}
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 5}
    mixed = spark.createDataFrame([("b", a), (None, a), ("a", a), ("c", f"{a} " * 400), ("c", None)], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["_n_removed"]) for r in line_dedup.dedup_lines(mixed).collect()) == [("None", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 0)]


@pytest.mark.parametrize("limit", [16, 2])
def test_line_links_lose_none(spark, limit):
    """Groups of edited copies, against all pairs by edit similarity; a limit of 2 leads all buckets."""
    rng = random.Random(5)
    base = [prose(rng, 40) for _ in range(12)]
    lines = list(base)
    for x in base[:4]:
        for _ in range(12):
            w = x.split()
            w[rng.randrange(len(w))] = "qu"
            lines.append(" ".join(w))
    line = dict(enumerate(dict.fromkeys(lines)))
    want = dict(zip(line, brute.closure(list(line), lambda i, j: brute.similar_lines(line[i], line[j]))))
    texts = line_dedup.with_blocks(line_dedup.described(spark.createDataFrame(list(line.items()), "k long, line string")))
    found = {r["node"]: r["component"] for r in connected_components(line_dedup.line_links(texts, bucket_limit=limit)).collect()}
    assert {i: found.get(i, i) for i in line} == want and len(set(want.values())) < len(line)


def test_a_passage_in_unlike_lines_hides_no_pair(spark):
    """All lines share a passage, so its buckets are large, and every pair of copies lies apart from the leader."""
    rng = random.Random(15)
    shared = prose(rng, 20, ("qu",))
    lines = []
    for _ in range(40):
        w = prose(rng, 40).split()
        other = list(w)
        other[rng.randrange(40)] = "changed"
        lines += [f"{' '.join(w)} {shared}", f"{' '.join(other)} {shared}"]
    texts = line_dedup.with_blocks(line_dedup.described(spark.createDataFrame(list(enumerate(lines)), "k long, line string")))
    found = {r["node"]: r["component"] for r in connected_components(line_dedup.line_links(texts, bucket_limit=4)).collect()}
    assert found == {i: i - i % 2 for i in range(len(lines))}


def test_a_block_is_the_simhash_of_a_run(spark):
    words = "some long words come first here".split()
    low = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.hash("w").alias("h"))
    hashed = {r["w"]: [r[f"h{k}"] & (1 << 64) - 1 for k in range(3)] for r in low.select("w", *[F.xxhash64("h", F.lit(k)).alias(f"h{k}") for k in range(3)]).collect()}
    (row,) = spark.createDataFrame([(" ".join(words),)], "line string").transform(line_dedup.described).select(line_dedup.line_blocks(F.col("words")).alias("b")).collect()
    want = set()
    for g in (3, 2):
        for i in range(len(words) - g + 1):
            run = [hashed[words[i + k]][k] for k in range(g)]
            want.add(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in run) > g))
    assert {b & (1 << 64) - 1 for b in row["b"]} == want and len(want) == 9


def test_decontamination(spark, texts, empty):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (3, 6, 15, 22, 40, 64)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " ")], "item_id long, text string")
    pad = lambda n: prose(rng, n)
    rows = [(i, f"{pad(rng.randint(0, 60))} {x} {pad(50)}") for i, x in enumerate(items)]
    rows += [(10 + i, f"{pad(9)} {x.upper().replace(' ', ', ')}") for i, x in enumerate(items)]
    w = items[4].split()
    rows += [(20, " ".join([*w[:20], "other", *w[21:]])), (21, None), (22, ""), (23, f"{pad(90_000)} {items[5]} {pad(10)}"), (24, pad(500))]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    must = {(i, i) for i in range(6)} | {(10 + i, i) for i in range(6)} | {(20, 4), (23, 5)}
    assert must <= got and not {g for g in got - must if g[1] > 1}
    left = decontaminate.drop_leaked(df, bench)
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {g[0] for g in got} and left.columns == df.columns
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.drop_leaked(df, bench.limit(0)).count() == len(rows)


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(8)
    index = decontaminate.build_index([(0, prose(rng, 40).encode())])
    size = index.sizes[0]
    for _ in range(300):
        fp = int(size.fps[0]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7)))
        assert any(0 in entries[first[v] : first[v + 1]] for b, (first, _, entries) in enumerate(size.tables) for v in [fp >> 16 * b & 0xFFFF])


def test_licenses(spark, empty):
    rng = random.Random(9)
    rows = []
    for i, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        rows.append((i, f"{prose(rng, rng.randint(0, 40))}\n{text}\n{prose(rng, 30)}"))
    rows += [(50, None), (51, ""), (52, prose(rng, 400))]
    got = {}
    for r in license_scan.find_licenses(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    names = sorted(license_scan.TEMPLATES)
    assert all(names[i] in got[i] for i in range(len(names))) and not {50, 51, 52} & set(got)
    assert license_scan.find_licenses(empty).count() == 0
    words = license_scan.TEMPLATES["MIT"].split()
    words[30] = "changed"
    index = license_scan.build_index(license_scan.TEMPLATES)
    (hits,) = license_scan.search(index, [" ".join(words).encode()], 0.8)
    assert [h[0] for h in hits] == ["MIT"] and 0.8 <= hits[0][1] < 1


def test_language(spark, empty):
    rng = random.Random(10)
    kinds = {"aa": "ka lo mi tan ver".split(), "bb": "sol en dar pu ri".split(), "cc": "go nel tis fra bul".split()}
    make = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(n))
    rows = [(i, make(k, 40), k) for i in range(90) for k in [rng.choice(sorted(kinds))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.col("doc_id") % 4 != 2)
    test = [(i, make(k, 12), k) for i in range(30) for k in [rng.choice(sorted(kinds))]] + [(90, None, None), (91, "12 !!", None), (92, "", None)]
    got = {r["doc_id"]: r for r in language_id.identify(clash(spark.createDataFrame(test, "doc_id long, text string, lang string")), model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in test[:30])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 92))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_phrases_are_longest_matches():
    model = language_id.build_model({"x": "abracadabra", "y": "simsalabim"})
    text = "abrasimcadabrasalaxz"

    def greedy(source, t):
        n = i = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in source:
                k += 1
            i, n = i + k, n + 1
        return n

    counts, sizes = language_id.phrase_counts(model, [text, None])
    assert counts[0].tolist() == [greedy("abracadabra", text), greedy("simsalabim", text)] and sizes.tolist() == [len(text), 0]


def test_parse_runs_across_blocks(monkeypatch):
    def greedy(source, t):
        n = i = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in source:
                k += 1
            i, n = i + k, n + 1
        return n

    rng = random.Random(4)
    word = lambda s, n: "".join(rng.choices(s, k=n))
    labelled = {"p": "a" * 7, "q": word("abc", 300), "r": word("abcd", 40)}
    model = language_id.build_model(labelled)
    texts = ["a" * 5000, "", "aab" * 700, *[word("abcdz", rng.randint(1, 3000)) for _ in range(20)], labelled["q"] * 9, None, "z", "a" * 700]
    want = [[greedy(labelled[k], t or "") for k in "pqr"] for t in texts]
    for block, lanes in ((512, 4096), (512, 3), (7, 5), (1, 2), (16, 1), (8192, 4)):
        monkeypatch.setattr(language_id, "BLOCK", block)
        monkeypatch.setattr(language_id, "LANES", lanes)
        assert language_id.phrase_counts(model, texts)[0].tolist() == want


def test_classifier(spark, empty):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        good = rng.random() < 0.7
        t = prose(rng, rng.randint(40, 400))
        rows.append((i, t if good else " ".join(w + rng.choice("#$%&") * 3 for w in t.split())))
        labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (999, 0), (3, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, known, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.classify(clash(docs), model).collect()}
    held = [(got[i], y) for i, y in labels if i % 3 == 0]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "x" * 100_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.classify(odd, model).collect())
    same = quality_classifier.train(docs.repartition(7), known, F.col("doc_id") % 3 != 0)
    assert all(np.allclose(model.weights[k], same.weights[k]) for k in model.weights)
    assert quality_classifier.train(docs, known.limit(0), F.lit(True)).prior == 0.5
    assert quality_classifier.classify(empty, model).count() == 0


def test_classifier_gradient():
    rng = np.random.default_rng(0)
    w = {k: rng.standard_normal(s) for k, s in {"W": (6, 5), "b": (5,), "V": (5, 4), "U": (5, 4), "w": (4,), "c": (5,), "d": (1,)}.items()}
    x, counts, y, weight = rng.standard_normal((9, 6)), np.array([2, 4, 3]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    first, bag = np.cumsum(counts) - counts, np.repeat(np.arange(3), counts)

    def loss():
        p = quality_classifier._forward(w, x, first, bag)["p"].ravel()
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    g = quality_classifier._gradient(w, x, first, bag, y, weight)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        kept, step = w[k][at], 1e-6
        w[k][at] = kept + step
        up = loss()
        w[k][at] = kept - step
        assert g[k][at] == pytest.approx((up - loss()) / (2 * step), rel=1e-3, abs=1e-6)
        w[k][at] = kept


def test_tokens(docs, texts, empty, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 64)
    tokens = token_counts.Tokenizer(token_counts.VOCABULARY)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(clash(docs)).collect()}
    assert got == {i: len(tokens.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_of_flat_files(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for k in range(3):
        ids = [rng.choice([0, 0, 1, 2, 3]) for _ in range(40)] if k else []
        np.array(ids, "<u2").tofile(str(tmp_path / f"f{k}.bin"))
        run, place = 0, 0
        for x in ids:
            run += 1
            if x == 0:
                want.append((k, place, run - 1, True))
                run, place = 0, place + 1
        if run:
            want.append((k, place, run, False))
    found = token_counts.scan(token_counts.read_files(spark, f"file://{tmp_path}", block_tokens=block), (0,))
    assert sorted((int(r["file"][-5]), r["place"], r["n_tokens"], r["closed"]) for r in found.collect()) == sorted(want)


def test_queries_and_sql_fit():
    from lodestone.llm import queries

    assert len(queries.queries()) == 13 and set(queries.oracle_sql()) <= set(queries.queries())
    assert json.dumps(queries.oracle_sql())
