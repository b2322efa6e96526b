"""Filter interaction audit: what each order of filters removes, from packed bitmaps.

Every partition packs, for each part, one bitmap a filter (bit set: the document fails) and
one a label. For each subset of the filters, AND-NOT of their bitmaps leaves what
passes all of them; popcounts of that, and of it with each label, are summed over partitions.
All figures follow from those sums: an order's step removes what its
prefix leaves less what prefix and filter leave.

Filters see whole texts; a null text is empty. Words are maximal runs without ASCII white
space, told apart by case.

At scale: texts are read once and become a row of five bits and a digest of 32 bytes; one
aggregation finds the least id of a repeated digest, two joins bring it and the labels back, apart from
the aggregations, so that a hot text can be split. A task sends one row of
counts for each part and subset that it holds.

Cases: a null id is never a copy of another row nor makes one, and has no labels; rows
of equal ids are no copies of each other; a label row counts as 1 if any of its id's is 1; an empty
table gives an empty result; columns other than id, text and source are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keep

_UPPER = bytes(range(65, 91))
_TAILS = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
_SIGNS = b"#$%&*|"


def few_words(t: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def few_distinct(t: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(t: bytes, words: list[bytes]) -> bool:
    return 100 * (len(t) - len(t.translate(None, _UPPER))) > 2 * len(t.translate(None, _TAILS))


def signs(t: bytes, words: list[bytes]) -> bool:
    return len(t.translate(None, _SIGNS)) < len(t)


#: Failure conditions on a text's UTF-8 bytes and words. ``COPY`` is the letter of the filter on copies.
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": signs}
COPY = "E"
LABELS = ("good", "toxic")


def failed_bits(docs: DataFrame, id_col: str, text_col: str, part_col: str, filters: dict[str, Callable[[bytes, list[bytes]], bool]]) -> DataFrame:
    """``(id, part, bits, digest)`` of every row; bit ``i`` is set if the text fails filter ``i``."""
    tests = list(filters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests = [], []
            for t in batch.column(2).cast(pa.binary()).to_pylist():
                t = t or b""
                words = t.split()
                bits.append(sum(1 << i for i, test in enumerate(tests) if test(t, words)))
                digests.append(hashlib.sha256(t).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "bits", "digest"])

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, part string, bits int, digest binary")


def _popcounts(n_filters: int):
    """Per part and subset of filters: documents that pass them all, and how many of these have each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            table = np.concatenate(list(held.values())) if held else np.zeros((0, 3), np.int64)
            parts = [p for p in held for _ in range(1 << n_filters)]
            subsets = np.tile(np.arange(1 << n_filters), len(held))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(subsets, pa.int32()), *(pa.array(table[:, k]) for k in range(3))], ["part", "subset", "kept", "good", "toxic"])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes, bits = names.indices.to_numpy(), batch.column(1).to_numpy()
            order = codes.argsort(kind="stable")
            codes, bits = codes[order], bits[order]
            ends = np.searchsorted(codes, np.arange(len(names.dictionary) + 1))
            for code, part in enumerate(names.dictionary.to_pylist()):
                some = bits[ends[code] : ends[code + 1]]
                fails = [np.packbits((some >> i & 1).astype(bool)) for i in range(n_filters)]
                labels = [np.packbits((some >> n_filters + i & 1).astype(bool)) for i in range(len(LABELS))]
                left = [np.packbits(np.ones(len(some), bool))]
                for subset in range(1, 1 << n_filters):  # a subset less its highest filter comes before it
                    high = subset.bit_length() - 1
                    left.append(left[subset ^ (1 << high)] & ~fails[high])
                found = np.array([[np.bitwise_count(x).sum(dtype=np.int64), *(np.bitwise_count(x & y).sum(dtype=np.int64) for y in labels)] for x in left], np.int64)
                held[part] = held[part] + found if part in held else found
            if len(held) > 1024:
                yield out()
                held.clear()
        yield out()

    return run


def subset_counts(bits: DataFrame, n_filters: int) -> DataFrame:
    """``(part, subset, kept, good, toxic)`` over all of ``bits(part, bits)``."""
    counted = bits.select("part", "bits").mapInArrow(_popcounts(n_filters), "part string, subset int, kept long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", *, filters: dict[str, Callable[[bytes, list[bytes]], bool]] = FILTERS) -> DataFrame:
    """One row per part, order of the filters (those of ``filters``, then copies) and step."""
    letters = [*filters, COPY]
    n = len(letters)
    read, _ = keep(failed_bits(docs, id_col, text_col, part_col, filters), "failed")
    lows = read.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high")
    lows, _ = keep(lows, "copies")
    known = labels.select(F.col(id_col).alias("of"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("of is not null")
    known, _ = keep(known.groupBy("of").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic")), "labels")
    copied = read.join(lows, "digest", "left").select("id", "part", F.col("bits").bitwiseOR(F.when(F.col("id") > F.col("low"), 1 << n - 1).otherwise(0)).alias("bits"))
    labelled = copied.join(known, F.col("id") == F.col("of"), "left")
    for i, name in enumerate(LABELS):
        labelled = labelled.withColumn("bits", F.col("bits").bitwiseOR(F.when(F.col(name), 1 << n + i).otherwise(0)))
    counts = subset_counts(labelled, n)

    table = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("kept", "good", "toxic")))).alias("at"))  # 2**n entries
    whole = (1 << n) - 1
    weight = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())  # noqa: E731  orders that begin so, then the filter
    at = lambda s, what="kept": F.element_at("at", s if not isinstance(s, int) else F.lit(s))[what]
    shares = F.array(*[sum((F.lit(weight(s)) * (at(s) - at(s | 1 << i)) for s in range(1 << n) if not s >> i & 1), F.lit(0).cast("long")) for i in range(n)])
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    wide = table.withColumn("shares", shares).select("part", "at", "shares", F.explode(orders).alias("filter_order"))
    wide = wide.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    nth = F.expr(f"instr('{''.join(letters)}', substr(filter_order, step, 1))")
    before = F.expr(f"aggregate(filter(sequence(1, {n}), k -> k < step), 0, (x, k) -> x + shiftleft(1, instr('{''.join(letters)}', substr(filter_order, k, 1)) - 1))")
    wide = wide.withColumns({"nth": nth, "before": before}).withColumn("own", F.expr("shiftleft(1, nth - 1)"))
    own = F.col("own")
    after = F.col("before").bitwiseOR(own)
    removed = at(F.col("before")) - at(after)
    return wide.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        at(after).alias("kept"),
        removed.alias("removed"),
        (at(0) - at(own) - removed).alias("redundant"),
        (at(F.lit(whole).bitwiseXOR(own)) - at(whole)).alias("unique_fails"),
        (at(F.col("before"), "good") - at(after, "good")).alias("good_lost"),
        (at(F.col("before"), "toxic") - at(after, "toxic")).alias("toxic_lost"),
        F.element_at("shares", F.col("nth")).alias("shapley"),
    )
