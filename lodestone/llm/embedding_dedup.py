"""Near-duplicate vectors by a robust-pruned flat graph.

Links are pairs with a cosine of ``threshold`` or more, in double precision. Equal
vectors are one node. Nodes are dealt to cells by k-means, split level by level until
each has ``cell_limit`` at most; a node also joins its next nearest cell. Each cell
builds a robust-pruned graph of its members (``vector_graph.build``), and the lists of a
node are united over its cells. Every node is then searched for: first in its own cell, from
the medoid, expanding everything in range; an edge into another cell that may lead to
something in range makes the search visit that cell too, in the next round, until no
search has a cell left to visit. A cell is searched for its own (home) nodes alone, so no pair
counts twice and no pair is ever written: a task gives counts, a forest of its
links, and the next visits.

At scale: k-means is fitted to a sample of ``sample`` nodes a cell (expected); all nodes are dealt and
indexed. What a task holds is one cell and at most about ``cell_limit`` searches.
Vectors that k-means can't part (of one direction, say) are parted by hash instead, and their
searches visit every part. Recall is audited against brute force on ``audit`` nodes
chosen by hash (all, if fewer) against all rows; below ``least_recall`` the graph is built again with
more overlap and a wider search, and after three builds the job fails.

Cases: a vector that is null, empty or zero, or holds a null or non-finite
component links with nothing; vectors of another length link with nothing of this
length; repeated rows and repeated ids are rows of their own and equal vectors are linked; a null id
joins its group, and is never its name unless all ids there are null; columns other
than id and vector are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keep
from lodestone.llm.components import connected_components
from lodestone.llm.vector_graph import build, centres, range_search, roots, unit

SEED = 11
FANOUT = 128
#: Searches of one cell that run in step.
STEP = 256
#: Entries that a visit brings along: the likeliest of those found.
ENTRIES = 4


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: nothing null or non-finite in it, and not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cells(nodes: DataFrame, limit: int, overlap: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """Members ``(cell, node, vec, home)`` of all cells, and ``(part, cell)`` of the cells parted by hash."""
    spark = nodes.sparkSession
    members = nodes.select(F.xxhash64(F.lit("all"), F.size("vec")).alias("cell"), "node", "vec", F.lit(True).alias("home"))
    parts = spark.createDataFrame([], "part long, cell long")
    level = 0
    while True:
        counts, _ = keep(members.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > limit), "cell-sizes")
        if counts.isEmpty():
            return members, parts
        sized = members.join(counts, "cell", "left")
        large = sized.where("n is not null")

        def fit(table: pa.Table) -> pa.Table:
            units, cell, n = unit(_matrix(table["vec"])), table["cell"][0].as_py(), table["n"][0].as_py()
            k = min(FANOUT, max(2, math.ceil(4 * n / limit)))
            found = centres(units, k, SEED)
            most = np.bincount((units @ found.T).argmax(axis=1)).max() / len(units)
            hashed = most > 0.8 or len(found) < 2
            if hashed:
                found = np.zeros((math.ceil(2 * n / limit), 0))
            return pa.table({"cell": [cell] * len(found), "n": [n] * len(found), "turn": range(len(found)), "hashed": [hashed] * len(found), "centre": found.tolist()}, schema=pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("turn", pa.int32()), ("hashed", pa.bool_()), ("centre", pa.list_(pa.float64()))]))

        share = F.pmod(F.xxhash64(F.lit(SEED + level), "node"), F.lit(1 << 20)) < F.lit(float(sample << 20)) / F.col("n")
        fitted = large.where(share).select("cell", "n", "vec").groupBy("cell").applyInArrow(fit, "cell long, n long, turn int, hashed boolean, centre array<double>")
        fitted, _ = keep(fitted.withColumn("child", F.xxhash64("cell", F.lit(level), "turn")), "centres")
        parts = parts.unionByName(fitted.where("hashed").select(F.col("cell").alias("part"), F.col("child").alias("cell")))

        def assign(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return out.empty_table()
            node, home = left["node"].to_numpy(), left["home"].to_numpy(zero_copy_only=False).astype(bool)
            child = right["child"].to_numpy()
            if right["hashed"][0].as_py():
                best, second = node % len(child), None
            else:
                near = unit(_matrix(left["vec"])) @ _matrix(right["centre"]).T
                width = min(overlap, near.shape[1])
                ranked = np.argsort(-near, axis=1, kind="stable")[:, :width]
                best, second = ranked[:, 0], ranked[:, 1:]
            tables = [pa.table([pa.array(child[best]), left["node"], left["vec"], pa.array(home)], schema=out)]
            for j in range(second.shape[1] if second is not None else 0):
                some = left.filter(pa.array(home))
                tables.append(pa.table([pa.array(child[second[home, j]]), some["node"], some["vec"], pa.array(np.zeros(len(some), bool))], schema=out))
            return pa.concat_tables(tables)

        element = pa.float64() if "double" in nodes.schema["vec"].simpleString() else pa.float32()
        out = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("vec", pa.list_(element)), ("home", pa.bool_())])
        chunks = F.ceil(F.col("n") / limit).cast("long")
        dealt = large.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(level)), chunks)).drop("n")
        copies = fitted.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "child", "hashed", "centre")
        moved = dealt.groupBy("cell", "chunk").cogroup(copies.groupBy("cell", "chunk")).applyInArrow(assign, f"cell long, node long, vec {nodes.schema['vec'].dataType.simpleString()}, home boolean")
        rest = sized.where("n is null").select("cell", "node", "vec", "home")
        members, _ = keep(rest.unionByName(moved), "cells")
        level += 1


_EDGES = pa.struct([("node", pa.int64()), ("cell", pa.int64()), ("angle", pa.float32())])


def _graph(members: DataFrame) -> DataFrame:
    """``(node, near)``: the united lists of every node, with each neighbour's home cell and angle."""

    def lists(table: pa.Table) -> pa.Table:
        units, node, base = unit(_matrix(table["vec"])), table["node"].to_numpy(), table["base"].to_numpy()
        order = node.argsort()
        units, node, base = units[order], node[order], base[order]
        near = build(units, SEED)
        a = np.repeat(np.arange(len(node)), near.shape[1])[near.ravel() >= 0]
        b = near.ravel()[near.ravel() >= 0]
        pair = np.unique(a * len(node) + b)
        a, b = pair // len(node), pair % len(node)
        angle = np.concatenate([np.arccos(np.clip(np.einsum("pd,pd->p", units[a[s : s + 65536]], units[b[s : s + 65536]]), -1, 1)) for s in range(0, max(1, len(a)), 65536)])
        ends = np.searchsorted(a, np.arange(len(node) + 1))
        edges = pa.StructArray.from_arrays([pa.array(node[b]), pa.array(base[b]), pa.array(angle.astype(np.float32))], fields=list(_EDGES))
        return pa.table({"node": pa.array(node), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), edges)})

    homes = members.where("home").select("node", F.col("cell").alias("base"))
    built = members.drop("home").join(homes, "node").groupBy("cell").applyInArrow(lists, "node long, near array<struct<node:long, cell:long, angle:float>>")
    # One list a cell of the node: their number is bounded by the levels and the overlap.
    return built.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"))


_FOUND = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("other", pa.int64()), ("amount", pa.int64()), ("entries", pa.list_(pa.int64()))])


def _search(threshold: float, beam: int):
    """Searches of a cell: counts (kind 0), a forest of links (1), and visits of further cells (2)."""
    reach = math.acos(threshold)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _FOUND.empty_table()
        order = left["node"].to_numpy().argsort()
        left = left.take(pa.array(order))
        units, node, copies = unit(_matrix(left["vec"])), left["node"].to_numpy(), left["copies"].to_numpy()
        cell, n = left["cell"][0].as_py(), len(left)
        lists = left["near"].combine_chunks()
        edge = lists.flatten()
        of = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
        to, base, angle = (edge.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        here = base == cell
        pair = np.unique(of[here] * n + np.searchsorted(node, to[here]))
        a, b = pair // n, pair % n
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        near = np.full((n, nth.max(initial=0) + 1), -1, np.int64)
        near[a, nth] = b
        of, to, base, angle = of[~here], to[~here], base[~here], angle[~here]
        first, last = np.searchsorted(of, np.arange(n)), np.searchsorted(of, np.arange(n), "right")
        medoid = int((units @ units.sum(axis=0)).argmax())

        who, queries = right["node"].to_numpy(), unit(_matrix(right["vec"]))
        starts = np.full((len(who), ENTRIES + 1), -1, np.int64)
        starts[:, 0] = medoid
        for i, some in enumerate(right["entries"].to_pylist()):
            starts[i, 1 : 1 + len(some)] = np.searchsorted(node, some)
        amount, links, visits = np.zeros(len(who), np.int64), [], []
        for s in range(0, len(who), STEP):
            q, x, cosine = range_search(units, near, queries[s : s + STEP], starts[s : s + STEP], threshold, beam)
            q += s
            apart = node[x] != who[q]
            np.add.at(amount, q[apart], copies[x[apart]])
            links.append((q[apart], x[apart]))
            # Edges into other cells that may lead to something in range.
            many = last[x] - first[x]
            pick = np.repeat(first[x] - np.concatenate(([0], many.cumsum()[:-1])), many) + np.arange(many.sum())
            by, gone = np.repeat(q, many), np.repeat(np.arccos(np.clip(cosine, -1, 1)), many)
            may = angle[pick] - gone <= reach + 1e-6
            by, pick, gone = by[may], pick[may], gone[may]
            if len(by):
                rank = np.lexsort((to[pick], gone + angle[pick], base[pick], by))
                by, pick = by[rank], pick[rank]
                new = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]) | (base[pick][1:] != base[pick][:-1]))))
                for i, e in zip(new, [*new[1:], len(by)]):
                    visits.append((int(who[by[i]]), int(base[pick[i]]), list(dict.fromkeys(to[pick[i:e]].tolist()))[:ENTRIES]))
        q, x = (np.concatenate(part) for part in zip(*links))
        names, place = np.unique(np.concatenate([who, node]), return_inverse=True)
        least = names[roots(len(names), place[: len(who)][q], place[len(who) :][x])]
        tied = names != least
        rows = int(tied.sum())
        none: list[list[int]] = [[]]
        return pa.concat_tables(
            [
                pa.table([pa.array(k, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int64()), pa.array(e, pa.list_(pa.int64()))], schema=_FOUND)
                for k, u, v, w, e in (
                    ([0] * len(who), who, [cell] * len(who), amount, none * len(who)),
                    ([1] * rows, names[tied], least[tied], [0] * rows, none * rows),
                    ([2] * len(visits), [v[0] for v in visits], [v[1] for v in visits], [0] * len(visits), [v[2] for v in visits]),
                )
            ]
        )

    return run


def _searched(nodes: DataFrame, *, threshold: float, cell_limit: int, overlap: int, sample: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """``(node, n)``: linked rows found elsewhere, and ``(a, b)``: links that join what is linked."""
    members, parts = _cells(nodes, cell_limit, overlap, sample)
    lists, _ = keep(_graph(members), "lists")
    homes = members.where("home").select("cell", "node", "vec")
    indexed, _ = keep(homes.join(lists, "node").join(nodes.select("node", "copies"), "node"), "graph")
    whole = parts.withColumnRenamed("cell", "own").join(parts, "part").select("own", "cell").where("own <> cell")
    beside = homes.withColumnRenamed("cell", "own").join(whole, "own").select("node", "cell", F.array().cast("array<long>").alias("entries"))
    visits, _ = keep(homes.select("node", "cell", F.array("node").alias("entries")).unionByName(beside), "visits")
    seen, found = visits.select("node", "cell"), None
    schema = "kind int, node long, other long, amount long, entries array<long>"
    while True:
        counts = visits.groupBy("cell").agg(F.ceil(F.count("*") / cell_limit).cast("long").alias("chunks"))
        counts, _ = keep(counts, "visit-sizes")
        asked = visits.join(nodes.select("node", "vec"), "node").join(counts, "cell")
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).select("cell", "chunk", "node", "vec", "entries")
        held = indexed.join(counts, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("cell", "chunk", "node", "vec", "copies", "near")
        got = held.groupBy("cell", "chunk").cogroup(asked.groupBy("cell", "chunk")).applyInArrow(_search(threshold, beam), schema)
        got, _ = keep(got, "found")
        found = got if found is None else found.unionByName(got)
        wanted = got.where("kind = 2").select("node", F.col("other").alias("cell"), "entries")
        likely = F.slice(F.array_distinct(F.flatten(F.collect_list("entries"))), 1, ENTRIES)
        wanted = wanted.join(seen, ["node", "cell"], "left_anti").groupBy("node", "cell").agg(likely.alias("entries"))
        visits, _ = keep(wanted, "visits")
        if visits.isEmpty():
            break
        seen = seen.unionByName(visits.select("node", "cell"))
    amounts = found.where("kind = 0").groupBy("node").agg(F.sum("amount").alias("n"))
    return amounts, found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b"))


def audited_recall(nodes: DataFrame, amounts: DataFrame, threshold: float, audit: int) -> float:
    """Share of the links of some nodes that were found, by brute force against all rows in blocks."""
    total = nodes.count()
    chosen = nodes.where(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 20)) < F.lit(float(audit << 20)) / F.lit(max(1, total)))
    asked = chosen.select("node", "vec").orderBy(F.xxhash64("node")).limit(2 * audit).collect()  # bounded by 2 * audit
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["vec"]) for r in asked}:
        some = [r for r in asked if len(r["vec"]) == d]
        by_length[d] = np.array([r["node"] for r in some]), unit(np.array([r["vec"] for r in some], np.float64))

    def count(batches):
        for batch in batches:
            node, copies, lengths = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).value_lengths().to_numpy()
            for d, (who, wanted) in by_length.items():
                some = lengths == d
                if some.any():
                    units = unit(_matrix(pa.chunked_array([batch.column(1).filter(pa.array(some))])))
                    hit = (wanted @ units.T >= threshold) & (who[:, None] != node[some][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array((hit * copies[some]).sum(axis=1))], ["node", "true"])

    true = nodes.select("node", "vec", "copies").mapInArrow(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    there, found = true.join(amounts, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0))))).first()
    return found / there if there else 1.0


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, threshold: float = 0.9, cell_limit: int = 2048, overlap: int = 2, sample: int = 4096, beam: int = 16, audit: int = 512, least_recall: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept and the audited recall of the links."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), usable(F.col(vec_col)).alias("ok"))
    each = rows.where("ok").groupBy("vec").agg(F.min("id").alias("owner"), F.count("*").alias("copies"))
    nodes, _ = keep(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    for attempt in range(3):
        amounts, links = _searched(nodes, threshold=threshold, cell_limit=cell_limit, overlap=overlap + attempt, sample=sample, beam=beam << attempt)
        recall = audited_recall(nodes, amounts, threshold, audit)
        if recall >= least_recall:
            break
    else:
        raise RuntimeError(f"{recall:.3f} of the audited links were found, {least_recall} are asked for")
    linked = connected_components(links)
    groups = nodes.select("node", "owner").join(linked, "node", "left").select("node", "owner", F.coalesce("component", "node").alias("component"))
    named, _ = keep(groups.groupBy("component").agg(F.min("owner").alias("component_id")), "named")
    known = nodes.select("vec", "node", "copies").join(amounts, "node", "left").join(groups.select("node", "component"), "node").join(named, "component")
    known, _ = keep(known.select("vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "known")
    good = rows.where("ok").join(known, "vec").select("id", "n_links", "component_id")
    alone = rows.where("not coalesce(ok, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("audited_recall"))
