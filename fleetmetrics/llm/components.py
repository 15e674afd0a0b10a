"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """The least node that each linked node can reach: ``node, component``, one row per node.

    Alternates the large-star and small-star steps until no link changes: each
    node's greater neighbours are hung on its least neighbour, then its lesser
    ones. A node's neighbours are only ever reduced to their minimum, so a node
    with links to a third of all others needs no task of its own; where they meet
    it, adaptive execution splits a node's links by their size. The number of
    rounds grows with the logarithm of the longest chain. Links of a node to
    itself make it a component; null ends are ignored.
    """
    a, b = F.col(left), F.col(right)
    known = links.where(a.isNotNull() & b.isNotNull())
    first = stored(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = first.where("u != v")
    before = None
    while True:
        # Large star: of all neighbours and the node itself the least, m; every greater neighbour is hung on m.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the lesser neighbours and the node itself are hung on the least of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        edges = stored(small, "links")
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
