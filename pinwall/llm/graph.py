"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.llm import common


def _jumped(parents: DataFrame) -> DataFrame:
    """node, root of a forest given as node, parent: path lengths halve until nothing changes."""
    now = parents
    while True:
        up = now.select(F.col("node").alias("p"), F.col("parent").alias("pp"))
        before, now = now, common.written(
            now.join(up, F.col("parent") == F.col("p"), "left").select("node", F.coalesce("pp", "parent").alias("parent"), (F.coalesce("pp", "parent") != F.col("parent")).alias("moved"))
        )
        common.discard(before)
        if now.where("moved").isEmpty():
            return now.select("node", F.col("parent").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of links (u, v: long, no nulls).

    Each round hooks every node to its smallest neighbour, flattens the trees, and contracts
    the links to roots; the nodes that still have links at least halve each time. A hub is a
    frequent join key against a table of one row a node, which Spark splits when it is skewed.
    """
    labels = None
    left = common.written(links.select("u", "v").where("u <> v").distinct())
    while not left.isEmpty():
        first = left
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = common.written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("parent")))
        roots = _jumped(hooked)
        if labels is None:
            labels = roots
        else:
            over = roots.select(F.col("node").alias("n"), F.col("root").alias("r"))
            labels = common.written(labels.join(over, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root")))
        for side in ("u", "v"):
            left = left.join(roots.select(F.col("node").alias(side), "root"), side, "left").drop(side).withColumnRenamed("root", side)
        over, left = first, common.written(left.select("u", "v").where("u <> v").distinct())
        common.discard(over)
    return labels if labels is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
