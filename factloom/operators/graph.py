"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import stage, unstage


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node; ``component`` is the
    smallest node reachable.

    Each round is two aggregations and two joins over at most as many edges as came in, so the work is
    O(edges log nodes). Rounds are staged in the shared folder, which keeps the plan short and lets a
    lost executor be replaced; a round's table is deleted when the next is written. Minima are combined before the shuffle; a hub's rows meet its single
    minimum in a join that adaptive execution can split. Null ends and self-edges are ignored.
    """
    x, y = F.col(a), F.col(b)
    now = stage(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = _digest(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, stage(linked.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(old)
        before, seen = seen, _digest(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
