"""Quality rules: a threshold table compiled into one projection.

``RULES`` is data. ``quality_rules`` turns it, with the measures it names, into
plain column expressions over one scan: no join, no shuffle, no user function.

Measures use words (maximal runs without ASCII white space) and code points.
Cases: a null or blank text has no words, measures of zero, and fails the base
rule; ratios over nothing are zero; ties and repeated rows are judged alone;
long texts are judged whole; an empty table gives an empty result; other input
columns are kept out of the way by reading only id and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import GAP, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of the languages that the corpus is meant to hold.
STOP_WORDS = tuple(
    """the of and to in a is that it for on was as with be by are this at an from or
    der die das und den von zu ist mit des ein eine auf für nicht im dem sich auch
    le la les de et un une que des en est dans pour qui sur par au du
    el los las y del que una con para su se por""".split()
)


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: A document is kept if every measure lies within its bounds, both included.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.5, high=12),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.05),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("capitals", "upper_ratio", high=0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _sorted_pairs(shingles: Column) -> Column:
    """(hash, position) pairs in order, so that equal windows stand side by side."""
    return F.sort_array(F.transform(shingles, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(pairs: str) -> Column:
    """Sorted positions of the windows that have an equal neighbour in the sorted column."""
    near = lambda i, p: F.coalesce(F.get(F.col(pairs), i)["h"] == p["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(F.col(pairs), lambda p, i: near(i - 1, p) | near(i + 1, p)), lambda p: p["i"]))


def measures(docs: DataFrame, carried: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``text`` and every measure of each row, beside the carried columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in carried.items()])
    split = read.withColumns(
        {
            "w": words_of(F.col("text")),
            "lines": F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
            "plain": F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != ""),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
            "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long"),
        }
    )
    n = F.size("w")
    windows = F.when(n < 3, F.array().cast("array<long>")).otherwise(F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2))))
    counted = split.withColumns(
        {
            "shingles": windows,
            "n_words": n.cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_stop": F.size(F.filter("plain", lambda x: x.isin(*STOP_WORDS))).cast("long"),
        }
    ).drop("lines", "plain", "w")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    paired = counted.withColumn("pairs", F.when(F.size(F.array_distinct("shingles")) == F.size("shingles"), none).otherwise(_sorted_pairs(F.col("shingles")))).drop("shingles")
    repeated = paired.withColumn("at", _repeated("pairs")).drop("pairs")
    # A repeated window covers three words, less those that the next one covers.
    gaps = F.transform(F.col("at"), lambda p, i: F.least(F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
    whole = repeated.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("at")
    return whole.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "stop_ratio": _ratio(F.col("n_stop"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
            "upper_ratio": _ratio(F.col("n_upper"), F.col("n_letters")),
        }
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean over the measures."""
    keep = F.lit(True)
    for r in rules:
        for bound in ([F.col(r.measure) >= r.low] if r.low is not None else []) + ([F.col(r.measure) <= r.high] if r.high is not None else []):
            keep = keep & bound
    return keep


def _decision(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """``base_failed`` and ``kept``.

    The id, which is never negative, makes ``kept`` a column that the optimiser
    doesn't substitute: a filter on it pushed below the measures would compute
    each of them once for every place where it stands in the rules.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return {"base_failed": base, "kept": ~base & verdict(rules) & (F.monotonically_increasing_id() >= 0)}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Id, measures, ``base_failed``, ``kept`` and the names of failed rules."""
    failed = F.filter(F.array(*[F.when(~verdict((r,)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    judged = measures(docs, {"id": F.col(id_col)}, text_col).drop("text")
    return judged.withColumns({**_decision(rules), "failed_rules": failed}).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    judged = measures(docs, {"row": F.struct(*[docs[c] for c in docs.columns])}, text_col)
    return judged.withColumns(_decision(rules)).where("kept").select("row.*")
