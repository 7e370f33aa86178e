"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revloom.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of ``edges`` (a, b).

    Each round gives a node the smallest root among its own and its neighbours' and then follows
    that root's own root. Roots only sink, so a round without change ends it; every round is a
    table in the shared folder.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    roots = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "cc-roots")
    while True:
        low = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        step = roots.join(low, roots.node == low.a).select("node", "root", F.least("root", "low").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = materialize(step.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("new")), "cc-roots")
        roots = moved.select("node", F.col("new").alias("root"))
        if moved.filter("new <> root").isEmpty():
            return roots
