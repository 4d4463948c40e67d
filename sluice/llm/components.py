"""Connected components by contraction, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is one node of its component, the same for all.

    Each round lets every node point at its smallest neighbour (or itself), follows two such pointers and
    contracts the edges; only nodes smaller than all their neighbours survive, so the edge list shrinks at
    least geometrically and a few rounds do. Every round is written out, which keeps the lineage short.
    """
    edges = work.save(edges.select("a", "b").filter("a <> b").distinct(), "edges-0")
    roots, step = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = work.save(parent, f"parent-{step}")
        for jump in range(2):
            parent = parent.join(parent.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))
        parent = work.save(parent, f"jumped-{step}")
        renamed = parent.select(F.col("a").alias("root"), F.col("p").alias("to"))
        roots = (
            parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
            if roots is None
            else roots.join(renamed, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        roots = work.save(roots, f"roots-{step}")
        pa, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        contracted = edges.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        step += 1
        edges = work.save(contracted.filter("a <> b").distinct(), f"edges-{step}")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
