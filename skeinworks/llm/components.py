"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a partial aggregate per node and a join, so a node that touches a third of all edges costs what its
edges cost: the aggregate combines in the map tasks and the sort-merge join's hot partition is split at run time.
Every second step is written with checkpoint(), so that lost executors redo one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. large: larger neighbours go to the node's least neighbour; else the smaller ones and the node."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u")
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: two columns of longs): root is the least node reachable.

    Self links and repeated or reversed edges change nothing; null ends are left out; no edges give an empty result.
    """
    a, b = edges.columns
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
        .checkpoint()
    )
    state = None
    for _ in range(MAX_ROUNDS):
        now = _star(_star(now, large=True), large=False).checkpoint()
        # in the last state each node points at its root, and another round changes nothing
        new = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
