"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from songloom.llm.common import stored


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``v -> p`` to the end, doubling the step each time."""
    while True:
        far = parents.alias("a").join(parents.alias("b"), F.expr("a.p = b.v"), "left").select(
            "a.v", F.coalesce("b.p", "a.p").alias("p"), (F.coalesce("b.p", "a.p") != F.col("a.p")).alias("moved")
        )
        far = stored(far)
        moving = not far.where("moved").isEmpty()
        parents = far.select("v", "p")
        if not moving:
            return parents


def connect(links: DataFrame) -> DataFrame:
    """``node, component`` of every linked node; ``links`` are rows ``a, b`` of longs.

    Each node points at its least neighbour if that is smaller. Every tree that arises is
    drawn together into its root, and links between roots go into the next round; at least
    half of the linked nodes go each time. Minima are combined before the shuffle, so a
    node with very many links costs a row per task.
    """
    edges, found = links.select("a", "b"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
        roots = _roots(stored(least.select("v", F.least("v", "p").alias("p"))))
        if found is None:
            found = roots.toDF("node", "component")
        else:
            found = found.alias("f").join(roots.alias("r"), F.expr("f.component = r.v"), "left").select(
                "f.node", F.coalesce("r.p", "f.component").alias("component")
            )
        edges = stored(
            edges.alias("e").join(roots.alias("x"), F.expr("e.a = x.v")).join(roots.alias("y"), F.expr("e.b = y.v"))
            .select(F.col("x.p").alias("a"), F.col("y.p").alias("b")).where("a <> b").distinct()
        )
        if edges.isEmpty():
            return stored(found)
