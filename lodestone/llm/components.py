"""Connected components as alternating star contractions.

Each round is two keyed aggregations and two joins over the edge table; no edge
or label is ever gathered on the driver. The least neighbours are written before they are
joined, so the many edges of a star's centre are joined apart from their aggregation and can be split. After a round every component is
closer to a star around its smallest node; the loop ends once all are stars. Edge tables are written to the shared scratch folder between rounds,
so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low, _ = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low, _ = keep(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each ``u`` once, and no ``v`` is a ``u`` too."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of one orderable type to ``(node, component)``.

    ``component`` is the smallest node reachable. Nodes without an edge to
    another node do not appear. Rows with a null end are ignored; repeated,
    reversed and self edges are harmless. Raises if ``max_rounds`` is too few.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = keep(now, "edges")
    for done in range(max_rounds + 1):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        if done == max_rounds:
            break
        large, large_path = keep(_large_star(now), "edges")
        after, new_path = keep(_small_star(large), "edges")
        drop(spark, path)
        drop(spark, large_path)
        now, path = after, new_path
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
