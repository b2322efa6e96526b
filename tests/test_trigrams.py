"""Patterns answered by postings against a scan of all names."""

import random

from pyspark.sql import functions as F

from lodestone.functions.text import ilike, name_pattern
from lodestone.operators import lookup as L
from lodestone.operators.trigrams import names_like, names_like_any, postings, required
from lodestone.plans.index import index_project
from lodestone.sources.store import Store
from tests.test_project import FILES, write


def test_required():
    assert required("%") == [] and required("%ab%") == [] and required("a%") == ["\x02\x02a"] and required("%ab_cd%") == []
    assert required("%aBcd%") == ["abc", "bcd"] and required("%é!%x%") == [] and required("%!_test%") == ["_te", "est", "tes"]
    assert set(required("ab")) == {"\x02\x02a", "\x02ab", "ab\x03", "b\x03\x03"} and required("aaaa%") == ["\x02\x02a", "\x02aa", "aaa"]


def test_postings_answer_as_a_scan_does(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abAB_%!.é") for _ in range(rng.randint(0, 7))) for _ in range(400)] + ["fetch", "Fetch.all", "x.catch", "İx", "Kelvin", "ΣΑΣ", "a" * 400]
    rows = spark.createDataFrame([(n, k % 9) for k, n in enumerate(names)] * 2, "name string, file_id long").cache()
    found = postings(rows, "symbol").unionByName(postings(rows.limit(5), "call")).cache()
    patterns = ["%", "a%", "%b", "%ab%", "ab", "a_b%", "%!_%", "%!%a%", "!!%", "%a%b%a%", "fetch%", "%.catch%", "k%", "%elv%", "%é%", "", "aaa%", "%σ", name_pattern("A*b"), name_pattern("%")]
    for p in patterns:
        want = {tuple(r) for r in rows.where(ilike(F.col("name"), p)).collect()}
        assert {tuple(r) for r in names_like(found, "symbol", p).collect()} == want, p
    both = names_like_any(found, "symbol", ("fetch%", "%.catch%")).collect()
    assert sorted(r["name"] for r in both) == ["Fetch.all", "fetch", "x.catch"]


def test_only_matching_postings_are_read(spark, tmp_path):
    root, store = str(tmp_path / "tree"), Store(spark, f"file://{tmp_path}/store")
    write(root, FILES)
    index_project(spark, root, store, 1)
    i = store.read()
    for query in ("sign*", "*e*", "store.open", "sign_n", "*"):
        seen = L.find_symbol(i.symbols, i.files, query, grams=i.grams)
        assert seen.collect() == L.find_symbol(i.symbols, i.files, query).collect()
    plan = L.find_symbol(i.symbols, i.files, "sign*", grams=i.grams)._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan  # pushed to the scan of sorted files
    for pattern in ("http_calls", "env_access"):
        by_scan = L.calls_like(i.calls, i.symbols, i.files, L.HTTP_CALLS if pattern == "http_calls" else L.ENV_ACCESS)
        assert [r["callee_name"] for r in by_scan.collect()] == [r["name"] for r in L.search_by_pattern(i, pattern).collect()]


def test_the_id_decides_ties_of_a_cut_list(spark):
    """Names of one file, kind and line: which of them a limit leaves is the same however the rows lie."""
    rows = [(k, 1, "twin", "function", 3, 4, True, None, "", k) for k in (*range(40, 60), *range(40))]
    symbols = spark.createDataFrame(rows, "symbol_id long, file_id long, name string, kind string, start_line int, end_line int, is_exported boolean, signature string, doc string, seq int").coalesce(1)
    files = spark.createDataFrame([(1, "a.py")], "file_id long, path string")
    for grams in (None, postings(symbols, "symbol")):
        assert [r["symbol_id"] for r in L.find_symbol(symbols, files, "tw*", limit=10, grams=grams).collect()] == list(range(10))
