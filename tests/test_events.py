import time

from lodestone.streaming.events import coalesced, debounced, listing_events, watch


def test_last_event_wins(spark):
    events = [("a", "add", 1), ("a", "change", 2), ("b", "change", 3), ("b", "unlink", 4), ("c", "unlink", 5), ("c", "add", 6), ("d", "change", 7), ("e", "add", 8), ("e", "unlink", 9), ("e", "change", 10)]
    got = {r[0]: r[1] for r in coalesced(spark.createDataFrame(events, "path string, event string, seq int")).collect()}
    assert got == {"a": "add", "b": "unlink", "c": "add", "d": "change", "e": "change"}


def test_bursts_and_listings(spark):
    ts = spark.sql("select 'a' path, timestamp_millis(x) ts from values (0L), (200L), (600L) v(x)")
    assert sorted(r["n"] for r in debounced(ts).collect()) == [1, 2]
    old, new = (spark.createDataFrame(x, "path string, mtime int") for x in ([("a", 1), ("b", 1), ("c", 1)], [("b", 2), ("c", 1), ("d", 1)]))
    assert {tuple(r) for r in listing_events(old, new).collect()} == {("a", "unlink"), ("b", "change"), ("d", "add")}


def test_watch_applies_one_event_a_path(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    schema = "path string, event string, ts timestamp, seq long"
    spark.sql("select 'a' path, 'add' event, timestamp'2024-01-01' ts, 1L seq union all select 'a', 'change', timestamp'2024-01-01', 2L").write.parquet(source)
    query = watch(spark.readStream.schema(schema).parquet(source), lambda df, i: seen.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    query.processAllAvailable()
    time.sleep(0.1)
    query.stop()
    assert seen == [("a", "add")]
