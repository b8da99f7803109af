"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) joined back on the node. A hub's rows can be split
by a skewed join, since nothing above the join needs a node's rows together. Labels never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over rows (u, v) with u > v. large: hang larger neighbours; else smaller ones and the node itself."""
    near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, stash: Stash, max_rounds: int = 60) -> DataFrame:
    """edges (a, b), any order, repeats and loops allowed -> (node, root), root the smallest node reachable.

    Only nodes that have an edge to another node appear. Ends when a round leaves the edges as they were: all are
    then (node, root). Raises if that takes more than max_rounds; the number of rounds grows with the logarithm
    of the longest path.
    """
    now, path = stash.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        got = now.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first()
        if tuple(got) == mark or got[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(got)
        after, fresh = stash.put(_star(_star(now, large=True), large=False))
        stash.drop(path)
        now, path = after, fresh
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
