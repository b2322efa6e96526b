"""TF-IDF: term statistics and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize, tokens_of


def term_frequencies(docs: DataFrame, id_col: str = "file_id", text_col: str = "content") -> DataFrame:
    """``(term, file_id, tf)``: a term's count over the largest count in its file."""
    terms = docs.select(F.col(id_col).alias("file_id"), F.explode(tokenize(F.col(text_col))).alias("term"))
    counts = terms.groupBy("file_id", "term").agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy("file_id"))
    return counts.select("term", "file_id", (F.col("n") / most).alias("tf"))


def inverse_frequencies(tf: DataFrame, n_files: int) -> DataFrame:
    """``(term, idf)``: ln(all files / files with the term). A file has a term once."""
    return tf.groupBy("term").agg(F.log(F.lit(float(n_files)) / F.count("*")).alias("idf"))


def scores(tf: DataFrame, idf: DataFrame, query: str) -> DataFrame:
    """``(file_id, score)`` of files with any term of ``query``; unknown terms weigh 1."""
    terms = sorted(set(tokens_of(query)))
    if not terms:
        return tf.select("file_id", F.lit(0.0).alias("score")).limit(0)
    weight = F.broadcast(idf.where(F.col("term").isin(terms)))  # a row for each query term at most
    hits = tf.where(F.col("term").isin(terms)).join(weight, "term", "left")
    return hits.groupBy("file_id").agg(F.sum(F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("score"))


def search_code(files: DataFrame, exports: DataFrame, tf: DataFrame, idf: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Best files: ``path``, ``score`` and up to five exported names, best first."""
    limit = max(1, min(50, limit))
    best = scores(tf, idf, query).join(files.select("file_id", "path"), "file_id").orderBy(F.desc("score"), "path").limit(limit)
    names = exports.where("not is_reexport").join(F.broadcast(best.select("file_id")), "file_id")  # 50 rows at most
    listed = names.groupBy("file_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "symbol"))), lambda x: x["symbol"]), 1, 5).alias("exports"))
    return best.join(listed, "file_id", "left").select("path", "score", F.coalesce("exports", F.array().cast("array<string>")).alias("exports")).orderBy(F.desc("score"), "path")
