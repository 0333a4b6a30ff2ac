"""Connected components of a distributed edge list, by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import settle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Point each node's neighbours (large: the greater ones, small: the smaller ones and itself) at the least of them all."""
    least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    `edges`: (a, b), undirected, any longs; loops and repeats do no harm. Each round is written to the shared folder, which
    cuts the lineage. Both stars keep connectivity, so stopping at a fixed point loses nothing; a graph that has not settled
    after `max_rounds` raises instead of giving a partial answer. Hubs: the least neighbour is a partial aggregate, and
    the join back is one that the engine can split.
    """
    now = settle(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        state = _state(now)
        if state == before or not state[0]:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        now = settle(_star(both, True))
        down = now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = settle(_star(down, False))
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
