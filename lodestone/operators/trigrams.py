"""Names found by their trigrams: postings that answer LIKE patterns.

A posting is a run of three signs of a lower-case name, which is framed by ``START`` and ``END`` so
that beginnings and ends count too. A pattern's literal runs name the trigrams that any match must
hold; only their postings are read, and the pattern itself is checked on what holds them all. Stored postings are
sorted by trigram, so a reader skips the rest by minimum and maximum.

A pattern that asks for no trigram (``%``, ``a%`` has one) is checked on all names instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ilike

START, END = "\x02\x02", "\x03\x03"


def grams_of(name: Column) -> Column:
    """Distinct trigrams of framed lower-case names."""
    framed = F.concat(F.lit(START), F.lower(name), F.lit(END))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(framed) - 2), lambda i: F.substr(framed, i, F.lit(3))))


def postings(names: DataFrame, kind: str) -> DataFrame:
    """``(gram, name, kind, file_id)`` of the names ``(name, file_id)``, each once a file."""
    return names.select("name", "file_id").distinct().select(F.explode(grams_of(F.col("name"))).alias("gram"), "name", F.lit(kind).alias("kind"), "file_id")


def required(pattern: str, escape: str = "!") -> list[str]:
    """Trigrams that every match of a LIKE pattern holds; signs beyond ASCII are left out, as their cases may differ."""
    run, runs, i = START, [], 0
    while i < len(pattern):
        sign = pattern[i]
        if sign == escape and i + 1 < len(pattern):
            i += 1
            sign = pattern[i]
        elif sign in "%_":
            sign = ""
        if sign and sign.isascii():
            run += sign.lower()
        else:
            runs, run = [*runs, run], ""
        i += 1
    runs.append(run + END)
    return sorted({r[k : k + 3] for r in runs for k in range(len(r) - 2)})


def names_like(found: DataFrame, kind: str, pattern: str) -> DataFrame:
    """``(name, file_id)`` of the postings ``found`` that match a LIKE pattern."""
    grams, own = required(pattern), found.where(F.col("kind") == kind)
    if not grams:
        return own.select("name", "file_id").distinct().where(ilike(F.col("name"), pattern))
    held = own.where(F.col("gram").isin(grams)).groupBy("name", "file_id").agg(F.count("*").alias("n"))
    return held.where((F.col("n") == len(grams)) & ilike(F.col("name"), pattern)).select("name", "file_id")


def names_like_any(found: DataFrame, kind: str, patterns: tuple[str, ...]) -> DataFrame:
    """Those that match any of the patterns; the postings of all trigrams asked for are read once."""
    asked = {p: required(p) for p in patterns}
    held = found.where(F.col("kind") == kind)
    if all(asked.values()):  # else a pattern wants every name
        held = held.where(F.col("gram").isin(sorted({g for grams in asked.values() for g in grams})))
    counts = [F.count(F.when(F.col("gram").isin(grams), 1)).alias(f"n{k}") for k, grams in enumerate(asked.values())]
    fits = [(F.col(f"n{k}") == len(grams)) & ilike(F.col("name"), p) for k, (p, grams) in enumerate(asked.items())]
    return held.groupBy("name", "file_id").agg(*counts).where(reduce(lambda a, b: a | b, fits)).select("name", "file_id")
