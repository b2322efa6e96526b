"""The operators bound to the driver's tables, each with the same query in SQL.

The driver's tables hold no source code, so a binding is an analogue by shape:
parts stand for symbols, brands for paths, and so on. What the operators mean
on code is tested on source fixtures in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import changes as C
from lodestone.operators import context as X
from lodestone.operators import graph as G
from lodestone.operators import lookup as L
from lodestone.operators import search as S
from lodestone.operators.folders import changes_by_folder
from lodestone.operators.trigrams import postings
from lodestone.plans import incremental as I
from lodestone.sources.store import last_wins, upsert
from lodestone.streaming.events import coalesced, listing_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bound(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOKENS = r"list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z0-9])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: length(x) > 1), lambda x: lower(x))"
_TF = f"""t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
tf AS (SELECT doc_id, term, n::DOUBLE / max(n) OVER (PARTITION BY doc_id) AS tf FROM n),
idf AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term)"""
_ASKED = "license version stupid disgusting"


@bound(f"""WITH {_TF} SELECT doc_id AS file_id, round(sum(tf * idf), 6) AS score FROM tf JOIN idf USING (term)
WHERE term IN ({", ".join(repr(w) for w in _ASKED.split())}) GROUP BY doc_id ORDER BY sum(tf * idf) DESC, doc_id LIMIT 20""")
def search_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    terms = sorted(set(T.tokens_of(_ASKED)))
    tf = S.term_frequencies(docs, "doc_id", "text").where(F.col("term").isin(terms)).persist()  # a few rows a document; texts are read once for both uses
    idf = S.inverse_frequencies(tf, docs.count())
    best = S.scores(tf, idf, _ASKED).orderBy(F.desc("score"), "file_id").limit(20)
    return best.select("file_id", F.round("score", 6).alias("score"))


@bound(f"WITH {_TF} SELECT term, round(idf, 6) AS idf FROM idf")
def idf_table(spark, d):
    docs = table(spark, d, "documents")
    tf = S.term_frequencies(docs, "doc_id", "text")
    return S.inverse_frequencies(tf, docs.count()).select("term", F.round("idf", 6).alias("idf"))


@bound(f"WITH {_TF} SELECT doc_id AS file_id, term, round(tf, 6) AS tf FROM tf")
def term_frequency_table(spark, d):
    return S.term_frequencies(table(spark, d, "documents"), "doc_id", "text").select("file_id", "term", F.round("tf", 6).alias("tf"))


@bound(f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, len(list_distinct({_TOKENS}))::BIGINT AS n_terms FROM documents")
def tokenize_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def _parts(spark, d):
    """Parts as symbols, brands as files."""
    p = table(spark, d, "part")
    files = p.select(F.xxhash64("p_brand").alias("file_id"), F.col("p_brand").alias("path")).distinct()
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), F.xxhash64("p_brand").alias("file_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_size").alias("start_line"), (F.col("p_size") + 1).alias("end_line"), (F.col("p_size") > 10).alias("is_exported"), F.lit(None).cast("string").alias("signature"), F.lit("").alias("doc"), F.col("p_partkey").cast("int").alias("seq"))
    return files, symbols


@bound("""SELECT p_name AS name, lower(p_type) AS kind, p_brand AS path, p_size AS start_line, p_partkey AS symbol_id FROM part
WHERE p_name ILIKE 'r%w%' ESCAPE '!' AND lower(p_type) = 'economy' AND p_brand ILIKE 'brand#1%' ESCAPE '!' ORDER BY name, path, start_line, kind LIMIT 1000""")
def find_symbol(spark, d):
    files, symbols = _parts(spark, d)
    return L.find_symbol(symbols, files, "R*w*", "economy", "brand#1", limit=1000).select("name", "kind", "path", "start_line", "symbol_id")


@bound("""WITH i AS (SELECT p_brand AS path, o_orderpriority AS symbol, c_mktsegment AS from_path FROM lineitem
 JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT 'import' AS kind, path, 0 AS line, symbol AS context FROM i WHERE symbol = '2-HIGH' AND from_path IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT DISTINCT 'call', p_brand, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey""")
def find_references(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    order, customer = table(spark, d, "orders"), table(spark, d, "customer")
    brands = part.select(F.xxhash64("p_brand").alias("file_id"), F.col("p_brand").alias("path")).distinct()
    segments = customer.select(F.xxhash64("c_mktsegment").alias("file_id"), F.col("c_mktsegment").alias("path")).distinct()
    files = brands.unionByName(segments)
    home = segments.where("path in ('BUILDING', 'MACHINERY')").select(F.lit(-1).cast("long").alias("symbol_id"), "file_id", F.lit("2-HIGH").alias("name"))
    names = part.select(F.col("p_partkey").alias("symbol_id"), F.xxhash64("p_brand").alias("file_id"), F.col("p_name").alias("name"))
    imports = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.xxhash64("p_brand").alias("file_id"), F.col("o_orderpriority").alias("symbol"), F.col("c_mktsegment").alias("from_path"), F.lit(False).alias("is_type_only"), F.lit(False).alias("is_external"), F.col("l_linenumber").alias("seq"))
    calls = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("caller_symbol_id"), F.lit("this.2-HIGH").alias("callee_name"), F.xxhash64("p_brand").alias("file_id"), F.col("l_linenumber").alias("line"))
    found = L.find_references(home.unionByName(names), files, imports, calls, "2-HIGH", limit=None)
    return found.withColumn("line", F.coalesce("line", F.lit(0)))


@bound("""SELECT n_name AS path, c_name AS symbol FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def unused_exports(spark, d):
    nation, customer, order = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders")
    files = nation.select(F.col("n_nationkey").cast("long").alias("file_id"), F.col("n_name").alias("path"))
    named = customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("file_id"), F.col("c_name").alias("symbol"))
    at = order.join(named, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(files.withColumnRenamed("path", "from_path")), "file_id")  # one row a nation
    imports = at.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("symbol", "from_path", F.lit(False).alias("is_external"))
    passed = at.where("o_totalprice > 450000").select("file_id", "symbol", F.lit("reexport").alias("kind"), F.lit(True).alias("is_reexport"), F.col("from_path").alias("original_path"))
    exports = named.select("file_id", "symbol", F.lit("function").alias("kind"), F.lit(False).alias("is_reexport"), F.lit(None).cast("string").alias("original_path")).unionByName(passed)
    symbols = named.select("file_id", F.col("symbol").alias("name"), F.lit(1).alias("start_line"))
    return L.unused_exports(exports, files, imports, symbols, limit=2**31 - 1).select("path", "symbol")


@bound("""SELECT source AS path, 'd' || doc_id AS name FROM documents d WHERE lang IN ('de', 'fr')
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND e.n_chars < 500)""")
def unused_code(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = docs.select(F.xxhash64("source").alias("file_id"), F.col("source").alias("path")).distinct()
    symbols = docs.select(F.xxhash64("source").alias("file_id"), name.alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), (~F.col("lang").isin("de", "fr")).alias("is_exported"))
    refs = labels.where("quality = 1").select(name.alias("name"))
    at = docs.select("doc_id", "source", "n_chars")
    imports = labels.where("toxic = 1").join(at, "doc_id").select(name.alias("symbol"), F.col("source").alias("from_path"), F.lit(False).alias("is_external"))
    exports = at.where("n_chars < 500").select(name.alias("symbol"), F.lit(True).alias("is_reexport"), F.col("source").alias("original_path"))
    return L.unused_code(symbols, files, refs, imports, exports, limit=2**31 - 1).select("path", "name")


@bound("""SELECT c_name AS path, coalesce(list_transform(list_sort(list({'k': o_orderkey, 's': o_orderpriority}) FILTER (o_orderkey IS NOT NULL)), lambda x: x.s), [])::VARCHAR[] AS exports
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey, c_name""")
def project_files(spark, d):
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("path"))
    exports = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("symbol"), (F.col("o_orderstatus") != "P").alias("is_reexport"), F.col("o_orderkey").alias("seq"))
    return G.project_map(files, exports)


def _tree_edges(spark, d):
    """Orders depend on customers, these on nations, and nations on regions."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    tag = lambda sign, col: F.concat(F.lit(sign), F.col(col).cast("string"))
    return (
        o.select(tag("o", "o_orderkey").alias("src"), tag("c", "o_custkey").alias("dst"), F.col("o_orderkey").alias("seq"))
        .unionByName(c.select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"), F.col("c_custkey").alias("seq")))
        .unionByName(n.select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"), F.col("n_nationkey").cast("long").alias("seq")))
    )


@bound("""WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w AS (SELECT src AS path, 1 AS depth, dst AS via FROM e WHERE dst = 'r1' UNION ALL SELECT e.src, w.depth + 1, e.dst FROM w JOIN e ON e.dst = w.path WHERE w.depth < 3)
SELECT path, depth, via FROM w""")
def dependents_of_region(spark, d):
    return G.dependency_levels(_tree_edges(spark, d), "r1", "dependents", 3)


@bound("""WITH RECURSIVE e AS (SELECT DISTINCT conv_id % 7 || ':' || turn AS src, conv_id % 5 || ':' || (turn + 1) AS dst FROM conversations),
w AS (SELECT dst AS path, 1 AS depth FROM e WHERE src = '1:0' UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.path WHERE w.depth < 6)
SELECT path, min(depth)::INTEGER AS depth FROM w WHERE path <> '1:0' GROUP BY path""")
def dependencies_by_turn(spark, d):
    c = table(spark, d, "conversations")
    edges = c.select(F.concat((F.col("conv_id") % 7).cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("src"), F.concat((F.col("conv_id") % 5).cast("string"), F.lit(":"), (F.col("turn") + 1).cast("string")).alias("dst")).distinct()
    return G.dependency_levels(edges.withColumn("seq", F.lit(0)), "1:0", "dependencies", 6).select("path", "depth")


def place(key: Column) -> Column:
    """The path of a place in a call tree as text that sorts as it does."""
    return F.array_join(F.transform(key, lambda x: F.lpad(x.cast("string"), 6, "0")), ".")


def walk_sql(children: str, root: str, depth: int) -> str:
    """A depth-first walk ``w`` in SQL, a row a step: the stack and what was expanded are lists in the row.

    ``children`` is a table ``(name, kids)`` of each name's callees in order.
    """
    kids = lambda key, level: f"list_transform(range(1, len(kids) + 1), lambda x: {{'n': kids[x], 'd': {level} + 1, 'k': {key} || lpad(x::VARCHAR, 6, '0')}})"
    return f"""w AS (SELECT '' AS key, 0 AS depth, name, true AS expanded, {kids("''", "0")} AS stack, [name] AS seen FROM {children} WHERE name = {root}
  UNION ALL SELECT top.k, top.d, top.n, opens, CASE WHEN opens THEN list_concat({kids("top.k || '.'", "top.d")}, rest) ELSE rest END, CASE WHEN opens THEN list_append(seen, top.n) ELSE seen END
  FROM (SELECT w.stack[1] AS top, w.stack[2:] AS rest, w.seen, t.kids, t.kids IS NOT NULL AND w.stack[1].d < {depth} AND NOT list_contains(w.seen, w.stack[1].n) AS opens
    FROM w LEFT JOIN {children} t ON t.name = w.stack[1].n WHERE len(w.stack) > 0))"""


@bound(f"""WITH RECURSIVE p AS (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
f AS (SELECT event_type, next, min(event_id) AS seq FROM p WHERE next IS NOT NULL GROUP BY ALL), h AS (SELECT event_type AS name, list(next ORDER BY seq) AS kids FROM f GROUP BY event_type),
{walk_sql("h", "'click'", 3)} SELECT key, depth::INTEGER AS depth, name, expanded FROM w""")
def call_tree(spark, d):
    """Event types that follow one another, as a call tree of depth 3."""
    e = table(spark, d, "events")
    pairs = e.select("event_id", "event_type", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next")).where("next is not null")
    first = pairs.groupBy("event_type", "next").agg(F.min("event_id").alias("seq"))
    files = e.select(F.lit(1).cast("long").alias("file_id"), F.lit("events").alias("path")).limit(1)
    symbols = e.select(F.xxhash64("event_type").alias("symbol_id"), F.lit(1).cast("long").alias("file_id"), F.col("event_type").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line")).distinct()
    calls = first.select(F.xxhash64("event_type").alias("caller_symbol_id"), F.col("next").alias("callee_name"), F.lit(1).alias("line"), F.col("seq"))
    rows = G.call_tree_rows(calls, symbols, files, "click", depth=3)
    return rows.select(place(F.col("key")).alias("key"), "depth", "name", "expanded")


@bound(r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS s FROM pages),
a AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS dir FROM p)
SELECT dir, len(string_split(dir, '/'))::INTEGER AS depth, count(*) AS files, 0::BIGINT AS exports FROM a GROUP BY dir""")
def directory_rollup(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    files = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), path.alias("path"))
    return G.directory_rollup(files)


@bound("""SELECT url AS path FROM pages WHERE url ILIKE '%.test.%' OR url ILIKE '%.spec.%' OR url ILIKE '%__tests__%' OR url ILIKE '%test/%' OR url ILIKE '%!_test.go' ESCAPE '!'
OR url ILIKE '%!_test.py' ESCAPE '!' OR url ILIKE '%/test!_%' ESCAPE '!' OR url ILIKE 'test!_%' ESCAPE '!' OR url ILIKE '%!_test.rs' ESCAPE '!' OR url ILIKE '%/tests/%.rs' OR url ILIKE '%spam%'""")
def pattern_paths(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("path"))
    return p.where(L.is_test_path(F.col("path")) | T.ilike_any(F.col("path"), ("%spam%",)))


@bound(f"""WITH t AS (SELECT DISTINCT source AS path, unnest({_TOKENS}) AS term FROM documents)
SELECT DISTINCT path FROM t WHERE term IN ('license', 'todo', 'apache')""")
def files_with_terms(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"))
    return L.files_with_terms(S.term_frequencies(docs, "doc_id", "text"), files, ("license", "todo", "apache"))


@bound(SQL["find_symbol"])
def find_symbol_by_trigrams(spark, d):
    """The same names by the postings of their trigrams."""
    files, symbols = _parts(spark, d)
    found = L.find_symbol(symbols, files, "R*w*", "economy", "brand#1", limit=1000, grams=postings(symbols, "symbol"))
    return found.select("name", "kind", "path", "start_line", "symbol_id")


@bound("""SELECT DISTINCT event_type AS callee_name, 'u' || user_id AS caller, (user_id % 9)::VARCHAR AS path, (value::INTEGER) AS line FROM events
WHERE event_type ILIKE 'err%' OR event_type ILIKE 'SIGN%'""")
def calls_like(spark, d):
    e = table(spark, d, "events")
    calls = e.select(F.col("user_id").cast("long").alias("caller_symbol_id"), F.col("event_type").alias("callee_name"), (F.col("user_id") % 9).cast("long").alias("file_id"), F.bround("value", 0).cast("int").alias("line"))
    symbols = e.select(F.col("user_id").cast("long").alias("symbol_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).distinct()
    files = e.select((F.col("user_id") % 9).cast("long").alias("file_id"), (F.col("user_id") % 9).cast("string").alias("path")).distinct()
    return L.calls_like(calls, symbols, files, ("err%", "SIGN%"))


@bound("""WITH s AS (SELECT user_id, ts < TIMESTAMP '2024-01-15' AS old, sum(event_id) AS h, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY ALL),
a AS (SELECT * FROM s WHERE NOT old), b AS (SELECT * FROM s WHERE old),
f AS (SELECT coalesce(a.user_id, b.user_id)::VARCHAR AS path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' END AS change, a.s AS n, b.s AS o FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT path, change, CASE WHEN change = 'modified' THEN list_filter(n, lambda x: NOT list_contains(o, x)) ELSE [] END AS added,
CASE WHEN change = 'modified' THEN list_filter(o, lambda x: NOT list_contains(n, x)) ELSE [] END AS removed FROM f WHERE change IS NOT NULL""")
def snapshot_changes(spark, d):
    e = table(spark, d, "events")
    state = lambda df: df.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.sum("event_id").cast("string").alias("hash"), F.array_sort(F.collect_set("event_type")).alias("symbols"))
    return C.changes(state(e.where("ts >= timestamp'2024-01-15'")), state(e.where("ts < timestamp'2024-01-15'")))


@bound(r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, page_id, md5(html) AS h FROM pages),
a AS (SELECT path, max(CASE WHEN page_id % 7 = 3 THEN 'new' ELSE h END) AS h FROM p WHERE page_id % 11 <> 5 GROUP BY path), b AS (SELECT path, max(h) AS h FROM p WHERE page_id % 13 <> 6 GROUP BY path)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def snapshot_changes_by_folder(spark, d):
    """Pages as files in folders: some gone, some new, some changed; compared by folder digests."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = table(spark, d, "pages").select(path.alias("path"), "page_id", F.md5("html").alias("h"))
    state = lambda df, h: df.groupBy("path").agg(F.max(h).alias("hash")).withColumn("symbols", F.array().cast("array<string>"))
    now = state(pages.where("page_id % 11 <> 5"), F.when(F.col("page_id") % 7 == 3, "new").otherwise(F.col("h")))
    return changes_by_folder(now, state(pages.where("page_id % 13 <> 6"), F.col("h"))).select("path", "change")


@bound("""SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN n_chars > 5000 THEN 'too_large' WHEN doc_id % 3 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 'read' ELSE 'unchanged' END AS status FROM documents
WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)""")
def incremental_status(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    listing = docs.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("mtime"), F.col("n_chars").alias("length"))
    files = docs.where("doc_id % 7 <> 0").select("path", F.lit(1).alias("mtime"), F.when(F.col("doc_id") % 11 == 0, "").otherwise("x").alias("hash"))
    return I.file_status(listing, files, 5000)


@bound("""SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS hash FROM documents WHERE doc_id % 6 <> 1 OR doc_id % 4 = 0""")
def upsert_files(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 6 <> 1").select(F.col("doc_id").alias("path"), F.col("lang").alias("hash"))
    return upsert(old, docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("path"), F.lit("new").alias("hash")))


@bound("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def last_row_wins(spark, d):
    return last_wins(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@bound("SELECT (SELECT count(*) FROM customer) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM orders) AS imports, (SELECT count(*) FROM supplier) AS exports, (SELECT count(*) FROM lineitem) AS calls")
def table_stats(spark, d):
    class Tables:
        files, symbols, imports, exports, calls = (table(spark, d, t) for t in ("customer", "part", "orders", "supplier", "lineitem"))

    return L.table_stats(Tables)


@bound("SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines, substr(sha256(text), 1, 16) AS hash FROM documents")
def line_counts_and_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"), T.content_hash(F.col("text")).alias("hash"))


@bound("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS source FROM documents")
def source_slices(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.source_lines(F.col("text"), F.lit(2), F.lit(4)), "\n").alias("source"))


@bound(r"""SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1) AS ext,
regexp_matches(regexp_replace(url, '^https?://', ''), '^blog\..*/[^/]*/9[^/]$') AS hit FROM pages""")
def globs_and_extensions(spark, d):
    bare = F.regexp_replace("url", r"^https?://", "")
    return table(spark, d, "pages").select("page_id", T.extension(F.regexp_replace("url", r"[?#].*$", "")).alias("ext"), T.matches_any_glob(bare, ["blog.**/*/9?"]).alias("hit"))


@bound("""SELECT o_orderkey AS seq, o_orderpriority AS symbol, c_name AS from_path, l.kind, l.start_line FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p, o_orderstatus AS kind, year(o_orderdate)::INTEGER AS start_line FROM orders WHERE o_orderstatus <> 'O') l ON l.k = o_custkey AND l.p = o_orderpriority""")
def imports_with_targets(spark, d):
    """Orders as imports of a name from a customer, whose other orders are its symbols."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    files = c.select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("path"))
    imports = o.join(files, F.col("o_custkey") == F.col("file_id")).select(F.lit(0).cast("long").alias("file_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("symbol"), F.col("path").alias("from_path"), F.lit(False).alias("is_type_only"), F.lit(False).alias("is_external"))
    symbols = o.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), F.lit("").alias("signature"), F.year("o_orderdate").alias("start_line")).distinct()
    return X.with_targets(imports, files, symbols).select("seq", "symbol", "from_path", "kind", "start_line")


@bound("SELECT o_custkey AS file, o_orderpriority AS symbol, min(o_orderkey) AS seq FROM orders GROUP BY ALL")
def first_occurrences(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("seq"))
    return X.distinct_in_order(rows, "symbol", "seq", by="file").select("file", "symbol", "seq")


@bound("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id::VARCHAR AS path, min(ts) AS burst_start, count(*) AS n FROM b GROUP BY user_id, k""")
def debounced_bursts(spark, d):
    from lodestone.streaming.events import debounced

    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "ts")
    return debounced(e, "2 hours").select("path", F.col("burst_start").cast("timestamp_ntz").alias("burst_start"), "n")


@bound("""WITH e AS (SELECT user_id AS path, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS event, event_id AS seq FROM events),
o AS (SELECT path, arg_max(event, seq) AS event, arg_max(event, seq) FILTER (event <> 'change') AS opened FROM e GROUP BY path)
SELECT path, CASE WHEN event = 'change' AND opened = 'add' THEN 'add' ELSE event END AS event FROM o""")
def coalesced_events(spark, d):
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return coalesced(table(spark, d, "events").select(F.col("user_id").alias("path"), kind.alias("event"), F.col("event_id").alias("seq")))


@bound("""SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'unlink' WHEN doc_id % 5 = 0 THEN 'add' ELSE 'change' END AS event FROM documents
WHERE (doc_id % 4 = 0) <> (doc_id % 5 = 0) OR (doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0)""")
def listing_differences(spark, d):
    docs = table(spark, d, "documents")
    before = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.lit(1).alias("mtime"))
    after = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("mtime"))
    return listing_events(before, after)
