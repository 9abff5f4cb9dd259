"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wastelake.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of `edges` (a, b).

    Each round hooks every node to its least neighbour, shortens the hooks to their ends by doubling,
    and draws the edges anew between those ends; at least half of the nodes with edges go each round.
    Every round is a set of written tables, so a lost executor costs one step, and joins start from
    files, so that adaptive execution can split the edges of a node with very many neighbours.
    Loops and repeated edges are allowed; no edges give no rows.
    """
    drawn = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = materialize(drawn.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while True:
        drawn = materialize(drawn.where("a != b").distinct(), "edges")
        if drawn.isEmpty():
            return roots
        ends = drawn.select(F.col("a").alias("node"), "b").unionByName(drawn.select(F.col("b").alias("node"), F.col("a").alias("b")))
        hooks = materialize(ends.groupBy("node").agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
        while True:
            onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            longer = materialize(hooks.join(onward, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hooks")
            hooks = longer.select("node", "to")
            if longer.where("moved").isEmpty():
                break
        roots = materialize(roots.join(hooks.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "nodes")
        drawn = drawn.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        drawn = drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
