"""Hard negatives for contrastive training, by a full sort of each anchor's scores.

Anchors are searched against all rows in tiles of ``tile_anchors`` by ``tile_rows``. In a
tile the integer scores of an anchor are computed and sorted whole (score
descending, id ascending). A first pass takes each anchor's first ``positives`` rows of its
label from every tile and merges them. The second sorts the tile again, finds each
positive's upper limit in the sorted scores by binary search, and reads the first
``negatives`` entries of other labels from there down to the lower limit; these are merged too.
The first of a whole list are among the first of its parts, so the merge loses nothing.

At scale: anchors against rows is the work asked for, and grows as their product. Of it only
the first few of a tile leave a task; a task holds one tile's rows and anchors, and a hot
label is dealt like any other. Anchors are a fixed share of rows, so they are dealt in
blocks and never broadcast.

Scores: each component x is floor(256 * x), x as double, and a score is the integer inner
product. Exact in double precision up to 2**53; beyond that whole numbers of any
size are used, and a score that is no long fails the job.

Cases: rows with a null id, label or vector, or any null or non-finite component take no part;
nor do rows of another length than the anchor's. Equal anchors (id, label and
vector) count once; other rows are rows of their own, even if equal, and rows of the
anchor's id are never its positives or negatives. An empty vector scores 0. An empty table gives an empty
result; columns other than id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keep

_EXACT = float(1 << 53)
#: Anchors whose scores are sorted at once in a tile.
STEP = 32


def complete(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))), F.lit(False))


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    """floor(256 * x) of vectors of one length, in double precision."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(256 * flat).reshape(len(column), -1)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, anchor by row."""
    a, b = np.abs(anchors).max(initial=0), np.abs(rows).max(initial=0)
    if a * b * max(1, rows.shape[1]) < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    exact = [[int(x) for x in v] for v in rows]
    return np.array([[sum(int(x) * y for x, y in zip(v, w)) for w in exact] for v in anchors], np.int64)


def _first_positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "id": [], "score": []}
        for anchor, who, label, ids, labels, scores in _sorted(left, right):
            same = np.flatnonzero((labels == label) & (ids != who))[:k]
            out["anchor"] += [anchor] * len(same)
            out["id"] += ids[same].tolist()
            out["score"] += scores[same].tolist()
        return pa.table(out, schema=pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

    return run


def _first_negatives(k: int, low: int, of: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "turn": [], "id": [], "score": []}
        wanted = dict(zip(right["anchor"].to_pylist(), right["positives"].to_pylist()))
        for anchor, who, label, ids, labels, scores in _sorted(left, right):
            other = (labels != label) & (ids != who)
            ids, scores = ids[other], scores[other]
            rising = -scores
            for turn, positive in enumerate(wanted[anchor]):
                top = positive["score"]
                start = int(np.searchsorted(rising, -top, "left"))
                end = int(np.searchsorted(rising, (-low * top) // of, "right"))
                end = min(end, start + k)
                if start < end:
                    out["anchor"] += [anchor] * (end - start)
                    out["turn"] += [turn] * (end - start)
                    out["id"] += ids[start:end].tolist()
                    out["score"] += scores[start:end].tolist()
        return pa.table(out, schema=pa.schema([("anchor", pa.int64()), ("turn", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]))

    return run


def _sorted(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """Each anchor of a tile with the tile's ids, labels and scores, by score descending and id ascending."""
    if not len(left) or not len(right):
        return
    rows, anchors = _whole(left["vec"]), _whole(right["vec"])
    ids, labels = left["id"].to_numpy(), left["label"].to_numpy()
    for s in range(0, len(anchors), STEP):
        scores = _scores(anchors[s : s + STEP], rows)
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)
        for i, (anchor, who, label) in enumerate(zip(*(right[c].to_pylist()[s : s + STEP] for c in ("anchor", "id", "label")))):
            yield anchor, who, label, ids[order[i]], labels[order[i]], scores[i][order[i]]


def _tiles(rows: DataFrame, anchors: DataFrame, tile_rows: int, tile_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors dealt to tiles ``(length, row_block, anchor_block)``: rows once a block of anchors, anchors once a block of rows."""
    sizes = rows.groupBy("length").agg(F.count("*").alias("n")).join(anchors.groupBy("length").agg(F.count("*").alias("m")), "length")
    blocks, _ = keep(sizes.select("length", F.ceil(F.col("n") / tile_rows).cast("long").alias("row_blocks"), F.ceil(F.col("m") / tile_anchors).cast("long").alias("anchor_blocks")), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = rows.join(blocks, "length").withColumn("row_block", F.pmod(F.xxhash64("id", "vec"), F.col("row_blocks"))).withColumn("anchor_block", every("anchor_blocks"))
    asked = anchors.join(blocks, "length").withColumn("anchor_block", F.pmod(F.xxhash64("anchor"), F.col("anchor_blocks"))).withColumn("row_block", every("row_blocks"))
    return dealt.drop("row_blocks", "anchor_blocks"), asked.drop("row_blocks", "anchor_blocks")


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | Column = "label", *, positives: int = 5, negatives: int = 5, low: int = 80, of: int = 100, tile_rows: int = 8192, tile_anchors: int = 1024) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` chooses the anchor rows. A negative fits a positive if low * positive_score
    <= of * negative_score <= of * positive_score.
    """
    vec, label = F.col(vec_col), F.col(label_col) if isinstance(label_col, str) else label_col
    read = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = read.where("id is not null and label is not null").where(complete(F.col("vec"))).withColumn("length", F.size("vec"))
    rows, _ = keep(rows, "vectors")
    chosen = rows.where("asked").drop("asked").distinct().withColumn("anchor", F.monotonically_increasing_id())
    chosen, _ = keep(chosen, "anchors")
    rows = rows.drop("asked")
    dealt, asked = _tiles(rows, chosen, tile_rows, tile_anchors)
    key = ("length", "row_block", "anchor_block")
    near = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_first_positives(positives), "anchor long, id long, score long")
    # A tile gives ``positives`` rows an anchor at most; sums of a few tiles are cut again before the last.
    best = _merged(near, ["anchor"], positives).select("anchor", F.col("found").alias("positives"))
    best, _ = keep(best, "positives")
    dealt, asked = _tiles(rows, chosen.join(best, "anchor"), tile_rows, tile_anchors)
    far = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_first_negatives(negatives, low, of), "anchor long, turn int, id long, score long")
    found = _merged(far, ["anchor", "turn"], negatives)
    named = chosen.select("anchor", F.col("id").alias("anchor_id")).join(best, "anchor").select("anchor", "anchor_id", F.posexplode("positives").alias("turn", "positive"))
    return (
        found.join(named, ["anchor", "turn"])
        .select("anchor_id", "positive", F.posexplode("found").alias("rank", "negative"))
        .select("anchor_id", F.col("positive.id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))
    )


def _merged(parts: DataFrame, key: list[str], k: int) -> DataFrame:
    """The first ``k`` of every key as an array of (id, score), merged in two steps so that no task gets all tiles' rows of a key."""
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k)
    some = parts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy(*key, "part").agg(first.alias("found"))
    again = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
    return some.groupBy(*key).agg(F.transform(again, lambda x: F.struct(x["id"].alias("id"), (-x["minus"]).alias("score"))).alias("found"))
