"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemine.session import cut


def connected_components(nodes: DataFrame, edges: DataFrame, *, max_rounds: int = 64) -> DataFrame:
    """(id, component) for every node in ``nodes(id)``; ``edges(a, b)`` are undirected. component is the smallest id.

    Each round hooks every vertex to the smallest vertex around it, flattens the chains by pointer jumping, and then
    contracts the graph: edges are renamed to their roots and duplicates and loops fall away, so the edge table
    shrinks geometrically. Every step is a join or a combined minimum; no neighbourhood is gathered. Each round is
    written to the shared checkpoint folder.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    edges = cut(edges.where("a <> b").distinct())
    for _ in range(max_rounds):
        if edges.isEmpty():
            return labels
        hook = cut(both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
        while True:
            upper = hook.select(F.col("a").alias("root"), F.col("root").alias("next"))
            jumped = cut(hook.join(upper, "root", "left").select("a", F.coalesce("next", "root").alias("next"), "root"))
            moved = not jumped.where("next <> root").isEmpty()
            hook = jumped.select("a", F.col("next").alias("root"))
            if not moved:
                break
        ha = hook.select("a", F.col("root").alias("ra"))
        hb = hook.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        edges = cut(edges.join(ha, "a").join(hb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
        new = hook.select(F.col("a").alias("component"), F.col("root").alias("_root"))
        labels = cut(labels.join(new, "component", "left").select("id", F.coalesce("_root", "component").alias("component")))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
