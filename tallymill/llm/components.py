"""Connected components of an edge table, by hooking and shortcutting of parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy


@tidy("components")
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the smallest node of the component.

    Each round hooks a node, and the node it points to, under the smallest grandparent among its neighbours, then
    halves the paths; the number of rounds grows with the logarithm of the longest path. Nothing is collected.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parent = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("f")).select(F.col("a").alias("node"), "f"), "parents")
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("f").alias("gf"))
        grand = materialize(parent.join(up, parent["f"] == up["p"]).select("node", "f", "gf"), "grandparents")
        near = both.join(grand.select(F.col("node").alias("b"), F.col("gf").alias("low")), "b").groupBy("a").agg(F.min("low").alias("low"))
        hooks = grand.join(near, grand["node"] == near["a"]).select("node", "f", "gf", F.least("gf", "low").alias("low"))
        moves = hooks.select("node", F.col("low").alias("f")).union(hooks.select(F.col("f").alias("node"), F.col("low").alias("f")))
        new = materialize(moves.groupBy("node").agg(F.min("f").alias("f")), "parents")
        changed = new.join(parent.withColumnRenamed("f", "was"), "node").filter(F.col("f") != F.col("was")).limit(1).count()
        parent = new
        if not changed:
            return parent.withColumnRenamed("f", "root")
