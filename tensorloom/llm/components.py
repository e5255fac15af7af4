"""Connected components of an edge table, by hooking to smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.session import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has an edge.

    Each round points all neighbours of a node, and the node itself, to the
    smallest of them, first over larger neighbours and then over smaller ones,
    until the edges stay the same. Only the fingerprint of the edge table comes
    to the driver. Neighbours are aggregated before they are shuffled, so a
    node with very many edges is not gathered in one task. Edges with NULL ends
    and loops are left out; repeated edges count once.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = durable(pair.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = None
    while True:
        # Every node v hooks its larger neighbours u to the smallest node around v.
        smaller = now.groupBy("u").agg(F.min("v").alias("m"))
        below = smaller.select(F.col("u").alias("v"), "m")
        large = now.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = large.unionByName(smaller.withColumnRenamed("m", "v")).distinct()
        # Every node u hooks its smaller neighbours, and itself, to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = durable(small.select("e.*").filter("u != v").distinct())
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
    # Stable: every u points to the smallest node of its component.
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
