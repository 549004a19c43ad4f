"""Connected components by alternating large-star and small-star steps.

Edges stay in DataFrames: each step is a grouped minimum and a join, and the
result of a round goes to the checkpoint folder. A node with very many neighbours
is a skewed join key, which adaptive execution splits; no neighbourhood is ever
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

EDGES_PER_TASK = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) both ways: ties the larger (large) or the smaller neighbours of each node to the least node around it."""
    near = edges if large else edges.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return joined.select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component: the least node that can be reached. Nulls have no edges."""
    now = checkpointed(edges.select(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y")).where(edges[a].isNotNull() & edges[b].isNotNull() & (edges[a] != edges[b])).distinct())
    while True:
        tasks = 1 + now.count() // EDGES_PER_TASK  # a short list of edges needs few tasks
        now = now.coalesce(tasks)
        for large in (True, False):
            both = now.select(F.col("x").alias("a"), F.col("y").alias("b"))
            now = _star(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), large).coalesce(tasks).distinct().coalesce(tasks)
        now = checkpointed(now)
        ends = now.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.lit(1).alias("below")), F.struct(F.col("y").alias("node"), F.lit(0).alias("below")))).alias("e")).groupBy("e.node").agg(F.sum("e.below").alias("below"), F.min("e.below").alias("least"))
        if ends.where("below > 1 or (below = 1 and least = 0)").isEmpty():  # every node hangs on one other, on which nothing but such nodes hang
            break
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct().coalesce(tasks))
