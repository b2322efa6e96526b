"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id, quality_classifier
from lodestone.llm.decontaminate import find_leaks
from lodestone.llm.embedding_dedup import near_vectors
from lodestone.llm.filter_audit import audit
from lodestone.llm.hard_negatives import hard_negatives
from lodestone.llm.license_scan import find_licenses
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.mixing import mix_counts
from lodestone.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from lodestone.llm.simhash_dedup import near_duplicates
from lodestone.llm.substring_dedup import remove_repeats
from lodestone.llm.token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, _remainder(5) != 0)
    found = quality_classifier.classify(docs, model)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, _remainder(4) != 2)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("text").alias("kept_text"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_license_scan": op2_license_scan,
        "op3_decontaminate": op3_decontaminate,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_language_id": op6_language_id,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_mix_sources": op9_mix_sources,
        "op10_line_dedup": op10_line_dedup,
        "op11_embedding_near_dedup": op11_embedding_near_dedup,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_filter_audit": op13_filter_audit,
    }


def _op1_sql() -> str:
    gap = r"[\x20\x09-\x0D]+"
    ratios = {
        "mean_word_chars": ("word_chars", "n_words"),
        "symbol_ratio": ("n_symbols", "n_words"),
        "stop_ratio": ("n_stop", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "upper_ratio": ("n_upper", "n_letters"),
    }
    value = lambda m: f"(CASE WHEN {ratios[m][1]} > 0 THEN {ratios[m][0]}::DOUBLE / {ratios[m][1]} ELSE 0 END)" if m in ratios else m
    bounds = [f"{value(r.measure)} >= {r.low}" for r in RULES if r.low is not None] + [f"{value(r.measure)} <= {r.high}" for r in RULES if r.high is not None]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{gap}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda x: x IN ({stop})) AS st FROM d),
u AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM s),
g AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g3 FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g3) AS n FROM g WHERE g3 IS NOT NULL),
k AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY r),
m AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(st)::BIGINT AS n_stop, len(l)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters
  FROM s LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(bounds)} AS kept FROM b"""


_OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM s),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
c AS (SELECT DISTINCT r, i + o AS p FROM g JOIN m USING (k), range(13) t(o) WHERE doc_id > low),
u AS (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM d),
l AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.r = u.r AND c.p = u.p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l USING (r)"""


_OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, pos AS positive_id, rank::INTEGER AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5"""


_OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
b AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS bits,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, bits),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, bit, list_sum(list_transform(string_split(o[1:step - 1], ''), lambda x: CASE x WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END))::INT AS before
  FROM (SELECT o, step, 1 << (ascii(o[step]) - 65) AS bit FROM o, range(1, 6) r(step))),
r AS (SELECT part, o, step, s.bit, sum(n) FILTER (bits & (coalesce(before, 0) | bit) = 0) AS kept, sum(n) FILTER (bits & coalesce(before, 0) = 0 AND bits & bit > 0) AS removed,
  sum(n) FILTER (bits & coalesce(before, 0) > 0 AND bits & bit > 0) AS redundant, sum(n) FILTER (bits = bit) AS unique_fails,
  sum(good) FILTER (bits & coalesce(before, 0) = 0 AND bits & bit > 0) AS good_lost, sum(toxic) FILTER (bits & coalesce(before, 0) = 0 AND bits & bit > 0) AS toxic_lost FROM c, s GROUP BY part, o, step, s.bit)
SELECT part, o AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op4_substring_dedup": _OP4_SQL, "op12_hard_negatives": _OP12_SQL, "op13_filter_audit": _OP13_SQL}
