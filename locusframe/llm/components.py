"""Connected components by alternating large-star and small-star rounds.

Edges never leave the cluster: each round is two grouped minima joined back to
the edges, and every round is cut into the checkpoint folder. The labels are
the smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge ``(u, v)``; self-loops are ignored.

    No edges give an empty result. Nodes without edges are not listed: they are
    components of their own.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").distinct())
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components have not settled")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
