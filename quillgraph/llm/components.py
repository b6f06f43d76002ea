"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges of a task, of 16 bytes each.
TASK_EDGES = 1_000_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs, any direction, to ``(node, root)`` with the smallest node that each one reaches;
    nodes that are their own root aren't listed.

    A round costs two aggregates with partial sums and two joins of edges with one row a node (a hub's edges are a
    skewed side that Spark may split); its edges go to the shared checkpoint folder.  The rounds grow with the
    logarithm of the longest path.  Self-loops, repeated edges and an empty table are fine.

    A round has as many tasks as its edges need, at ``TASK_EDGES`` each: the edges are few beside what they came from, and
    a round of many nearly empty tasks would cost more files than rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        few = max(1, -(-state[0] // TASK_EDGES))
        now = now.coalesce(few)
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour (or to itself)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # 'now' holds each pair with its larger node first: the larger neighbours of v are its u's
        large = now.join(least, now.v == least.c).select("u", F.col("m").alias("v")).where("u <> v").distinct().coalesce(few)
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        tied = large.join(low, large.u == low.c)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(few))
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
