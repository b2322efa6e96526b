"""Token files that no manifest names, and what scratch tables leave behind."""

import os
from concurrent.futures import ThreadPoolExecutor

from lodestone.llm import common, token_counts


def test_files_of_lost_attempts_are_not_counted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words of a text " * i) for i in range(40)], "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, token_counts.count_tokens(docs).collect()))
    write = token_counts.write_tokens

    def leftover(*args):
        folder, manifest, end = write(*args)
        here = folder.removeprefix("file://")
        taken = {f"{r['file']}.tokens" for r in manifest.select("file").distinct().collect()}
        assert set(f for f in os.listdir(here) if f.endswith(".tokens")) == taken
        with open(f"{here}/{(1 << 40) + 7}.tokens", "wb") as lost:  # cut off within an id
            lost.write(bytes(range(1, 12)))
        return folder, manifest, end

    monkeypatch.setattr(token_counts, "write_tokens", leftover)
    assert sorted(map(tuple, token_counts.count_tokens(docs).collect())) == want


def test_a_file_ends_with_a_document(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 8)
    monkeypatch.setattr(token_counts, "FILE_BLOCKS", 2)
    docs = spark.createDataFrame([(i, "word " * i) for i in (0, 1, 40, 3, 15, 16, 17, 2)], "doc_id long, text string").coalesce(1)
    _, manifest, _ = token_counts.write_tokens(docs)
    assert manifest.select("file").distinct().count() > 3
    tokens = token_counts.Tokenizer(token_counts.VOCABULARY)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()} == {r["doc_id"]: len(tokens.ids(r["text"])) for r in docs.collect()}


def test_bucketed_tables_leave_no_name(spark):
    before = {t.name for t in spark.catalog.listTables()}
    _, first = common.keep(spark.range(9), "named", by="id")
    table, second = common.keep(spark.range(9), "named", by="id")
    assert len({t.name for t in spark.catalog.listTables()} - before) == 2
    common.drop(spark, first)
    assert table.count() == 9 and not os.path.exists(first.removeprefix("file://"))
    common.drop(spark, second)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_settings_are_put_back_after_writers_side_by_side(spark):
    now = lambda: {k: spark.conf.get(k, None) for k in common.WRITING}
    before = now()
    with ThreadPoolExecutor(6) as pool:
        counts = list(pool.map(lambda n: common.keep(spark.range(n), "side")[0].count(), range(12)))
    assert counts == list(range(12)) and now() == before
