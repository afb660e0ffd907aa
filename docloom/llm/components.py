"""Connected components of links between nodes, in rounds of joins.

Large-star and small-star rounds (Kiveris et al., 2014): each round rewires every
node to the least node it sees, which halves the depth of the trees; a hot node's
links are only ever grouped by aggregation. Rounds are written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``(a, b)``; the component is its least node."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        large = _star(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = materialize(_star(large, larger=False))
        edges = small
        if _settled(edges):
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on anything."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(edges.select("v", F.lit(0), F.lit(1)))
    open_nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.sum("below").alias("below")).where("above > 1 or (above > 0 and below > 0)")
    return open_nodes.isEmpty()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links from each node's neighbours to the least of them and itself.

    ``larger``: ``edges`` holds both directions and only greater neighbours are
    rewired; otherwise each edge points from the greater node to the smaller one
    and all of a node's smaller neighbours are, with the node itself.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()
