"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text gets a 64-bit SimHash of its word shingles. Fingerprints at most
``radius`` bits apart are linked and the connected groups are returned.

Covering: bit ``i`` of the fingerprint gets a nonzero vector ``m(i)`` of
``radius + 1`` bits; for each nonzero vector ``v`` the mask keeps the bits with
an odd ``m(i) . v``. Bits where two fingerprints differ are at most ``radius``
many, so some ``v`` is orthogonal to all their vectors, and under that mask the
two agree: no pair within the radius is lost.

Work is on distinct fingerprints; copies of a text cost one row. Buckets are counted
first, combined before the shuffle. One of up to ``bucket_limit`` fingerprints is searched in one task, which emits a spanning
forest and not its pairs. A larger one is never gathered:
its members are keyed by every choice of ``radius`` cleared bits outside the
mask. Members under one key differ in those bits only, so they are at most
2^radius, all linked, and one star joins them.

Cases: a null or blank text has fingerprint zero, linked like any other; a text
of fewer words than a shingle is one shingle; repeated rows and repeated ids stay
as rows; a null id joins its group, but never names it unless all ids there are
null; an empty table gives an empty result. Columns other than id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.common import keep
from lodestone.llm.components import connected_components

BITS = 64


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """Unsigned fingerprint of a UTF-8 text; only A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    at, to = starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(at), block):
        part = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(at[i : i + block], to[i : i + block])], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(at), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(id, h, fp)``: a hash of the text and the fingerprint, signed, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "h", "fp"])

    text = F.col(text_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, h long, fp long")


def covering_masks(radius: int) -> list[int]:
    """One mask for each nonzero vector of ``radius + 1`` bits, as unsigned ints."""
    vectors = (1 << (radius + 1)) - 1
    given = [1 + i % vectors for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(given) if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints (unsigned)."""
    left, out = members, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                out += [(int(x), int(h)) for h in hit]
                front += list(hit)
                left = left[~near]
    return out


def _search(radius: int):
    """Links inside runs of equal (mask, key), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if size > 1 and (rows := _forest(np.unique(np.concatenate(held)), radius)):
                ends = np.array(rows, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            mask = batch.column(0).to_numpy(zero_copy_only=False)
            hashed = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (hashed[1:] != hashed[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(fp)]):
                if s == e:
                    continue
                if (this := (mask[s], hashed[s])) != key:
                    yield from close()
                    key, held, size = this, [], 0
                size += e - s
                held.append(fp[s:e])
        yield from close()

    return run


def _cleared(masks: list[int], radius: int):
    """Members of large buckets under every choice of cleared bits outside the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, x in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)):
                free = [i for i in range(BITS) if not masks[m] >> i & 1]
                choice = np.array([sum(1 << i for i in c) for c in combinations(free, radius)], np.uint64)
                n = len(choice)
                yield pa.RecordBatch.from_arrays([pa.array(choice.view(np.int64)), pa.array((x & ~choice).view(np.int64)), pa.array(np.full(n, x, np.uint64).view(np.int64))], ["choice", "rest", "fp"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``distinct(fp)`` within the radius."""
    masks = covering_masks(radius)
    table = F.array(*[F.lit(_signed(m)) for m in masks])
    keyed = distinct.select("fp", F.posexplode(table).alias("mask", "bits")).select("mask", F.expr("fp & bits").alias("key"), "fp")
    crowded, _ = keep(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_limit).drop("n"), "crowded")
    # Small buckets meet in a task. A large one never does: its members are joined where they are, which can be split.
    runs = keyed.join(crowded, ["mask", "key"], "left_anti").repartition("mask", "key").sortWithinPartitions("mask", "key")
    found = runs.mapInArrow(_search(radius), "a long, b long")
    large = keyed.join(crowded, ["mask", "key"], "left_semi").select("mask", "fp")
    stars = (
        large.mapInArrow(_cleared(masks, radius), "choice long, rest long, fp long")
        .groupBy("choice", "rest")
        .agg(F.collect_set("fp").alias("all"), F.min("fp").alias("a"))  # 2^radius members at most
        .where(F.size("all") > 1)
        .select("a", F.explode("all").alias("b"))
        .where("a <> b")
    )
    return found.unionByName(stars)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, bucket_limit: int) -> DataFrame:
    """``(id, h, fp, component_id)`` of every row."""
    fps, _ = keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    owners, _ = keep(fps.groupBy("fp").agg(F.min("id").alias("owner")), "owners")
    linked = connected_components(fingerprint_links(owners.select("fp"), radius, bucket_limit))
    groups = owners.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "owner", F.coalesce("component", "fp").alias("component"))
    named = groups.groupBy("component").agg(F.min("owner").alias("component_id"))
    ids, _ = keep(groups.join(named, "component").select("fp", "component", "component_id"), "groups")
    return fps.join(ids, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """One row per document: id, ``fp`` (signed long) and ``component_id``."""
    found = _grouped(docs, id_col, text_col, shingle, radius, bucket_limit)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest id (null last), then text hash."""
    found = _grouped(docs, id_col, text_col, shingle, radius, bucket_limit)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"))
    chosen = first.select(F.col("first.id").alias("_id"), F.col("first.h").alias("_h"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(id_col).alias("_i"), F.xxhash64(text).alias("_t"))
    left = rows.join(chosen, rows["_i"].eqNullSafe(chosen["_id"]) & (rows["_t"] == chosen["_h"]), "left_semi")
    copy = F.row_number().over(W.partitionBy("_i", "_t").orderBy(F.lit(0)))  # repeated rows
    return left.withColumn("_copy", copy).where("_copy = 1").select("_row.*")
