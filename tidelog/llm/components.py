"""Connected components of an edge table, by alternating large-star and small-star rounds.

The hub of a star is never a single task's load: neighbours' minima are combined on the map side,
and the join that hands them back is one that adaptive execution may split. Each round is cut off
by a checkpoint; rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Each node ties its larger (or smaller) neighbours to its minimum.

    The minima are a table of their own, so that Spark may split a hub's edges in the join.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    tied = edges.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return checkpointed(tied.where("u <> v").distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b; long); root is the least node reachable."""
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = _star(_star(now, large=True), large=False)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
