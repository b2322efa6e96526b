"""What an index run does to its tables, bound to the driver's tables and to the tree derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import changes as C
from lodestone.operators import search as S
from lodestone.plans import incremental as I
from lodestone.plans.bound import _TOKENS, bound, table
from lodestone.plans.bound_code import _TREE, derived_index, sources
from lodestone.plans.index import frequency_changes
from lodestone.sources.config import Config
from lodestone.sources.scan import selected
from lodestone.sources.store import invalidated, without_files


@bound(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN text || ' added ' || lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 2),
t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM d) SELECT term, round(ln((SELECT count(*) FROM d)::DOUBLE / count(*)), 6) AS idf FROM t GROUP BY term""")
def idf_by_deltas(spark, d):
    """Weights after some documents are gone and some have changed, from the counts before and what those alone add and take off."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text", "lang")
    before = S.term_frequencies(docs, "file_id", "text")
    counted = before.groupBy("term").agg(F.count("*").alias("n"))
    changed = docs.where("file_id % 5 = 1 and file_id % 7 <> 2").withColumn("text", F.concat_ws(" ", "text", F.lit("added"), "lang"))
    touched = docs.where("file_id % 5 = 1 or file_id % 7 = 2")
    deltas = frequency_changes(S.term_frequencies(changed, "file_id", "text"), S.term_frequencies(touched, "file_id", "text"), touched.select("file_id"))
    after = counted.unionByName(deltas).groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")
    n = docs.where("file_id % 7 <> 2").count()
    return after.select("term", F.round(F.log(F.lit(float(n)) / F.col("n")), 6).alias("idf"))


@bound("SELECT user_id::VARCHAR AS path, sum(event_id)::VARCHAR AS hash, user_id % 3 = 0 AS bare, CASE WHEN user_id % 3 = 0 THEN [] ELSE list_sort(list(DISTINCT event_type)) END AS symbols FROM events GROUP BY user_id")
def legacy_snapshot(spark, d):
    """A snapshot in which every third file has the old form, a bare hash."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.sum("event_id").cast("string").alias("hash"), F.array_sort(F.collect_set("event_type")).alias("symbols"))
    new = F.to_json(F.struct("hash", "symbols"))
    value = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('"'), "hash", F.lit('"'))).otherwise(new)
    entry = F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('":'), value)
    text = e.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("file_snapshot"))
    return C.snapshot_rows(text).select("path", "hash", F.col("symbols").isNull().alias("bare"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


@bound("""WITH a AS (SELECT user_id, sum(event_id) AS h FROM events GROUP BY user_id), b AS (SELECT user_id, sum(event_id) AS h FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id)::VARCHAR AS path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.h IS DISTINCT FROM b.h""")
def changes_since_session(spark, d):
    """Against the newest session that was closed: an older one and an open one hide nothing."""
    e = table(spark, d, "events")
    state = lambda df: df.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.sum("event_id").cast("string").alias("hash")).withColumn("symbols", F.array().cast("array<string>"))
    closed = C.snapshot_json(state(e.where("ts < timestamp'2024-01-15'")))
    sessions = closed.select(F.lit(2).alias("session_id"), "file_snapshot").unionByName(spark.sql("select 1 session_id, '{}' file_snapshot union all select 3, null"))
    return C.changes(state(e), C.snapshot_rows(C.last_snapshot(sessions))).select("path", "change")


@bound(f"{_TREE} SELECT p AS path, CASE WHEN k = 3 THEN ['M' || i, f] ELSE [f] END AS symbols FROM m")
def code_state(spark, d):
    """Every file with its exported names in order."""
    i = derived_index(spark, d)
    return C.current_state(i.files, i.symbols).select("path", "symbols")


@bound(f"{_TREE} SELECT p AS path FROM m WHERE k IN (0, 1) AND p NOT LIKE 'lib/m1%'")
def selected_files(spark, d):
    """Included folders and languages, without what a glob leaves out."""
    config = Config(include=["src/", "lib/"], exclude=["lib/m1*.py"], languages=["typescript", "python"])
    return selected(sources(spark, d), config).select("path")


@bound("SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN false ELSE true END AS touched FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 4 = 1")
def content_checks(spark, d):
    """Files read again: whether their content is the one indexed; one that is not indexed is new."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), T.content_hash(F.col("text")).alias("hash"))
    files = docs.where("path % 4 <> 1").select("path", F.when(F.col("path") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return I.content_status(docs, files).select("path", "touched")


@bound(r"""WITH p AS (SELECT page_id, replace(url, '/', chr(92)) AS raw FROM pages), n AS (SELECT page_id, replace(raw, chr(92), '/') AS path FROM p)
SELECT page_id, path, regexp_extract(path, '[^/]*$') AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM n""")
def path_parts(spark, d):
    p = table(spark, d, "pages").select("page_id", T.normalized_path(F.translate("url", "/", "\\")).alias("path"))
    return p.select("page_id", "path", T.base_name(F.col("path")).alias("base"), T.directory(F.col("path")).alias("folder"))


@bound("""WITH e AS (SELECT event_id, (epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(ts)) / 1000.0 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60 + 0.5)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600 + 0.5)::BIGINT || 'h ago' ELSE floor(s / 86400 + 0.5)::BIGINT || 'd ago' END AS age FROM e""")
def ages(spark, d):
    then = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    now = F.unix_millis(F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", T.age_text(then, now).alias("age"))


@bound("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def rows_without_files(spark, d):
    """Rows of the files that are gone leave a per-file table with them."""
    rows = table(spark, d, "conversations").withColumnRenamed("conv_id", "file_id")
    gone = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("file_id"))
    return without_files(rows, gone).select(F.col("file_id").alias("conv_id"), "turn")


@bound("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN '' ELSE lang END AS hash, '' AS all_hash FROM documents")
def invalidated_files(spark, d):
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("doc_id").cast("string")).first()[0]
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("hash"))
    one, every = invalidated(files, first), invalidated(files).select("path", F.col("hash").alias("all_hash"))
    return one.join(every, "path")
