"""Connected components of a graph of links, in rounds of joins over its edges only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_rows, join_spread, materialize


def connected_components(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Edges are directed from the larger end u to the smaller end v. A round has two steps: all the
    smaller neighbours of a node are linked to the smallest of them; then an edge moves its smaller
    end to that end's own smallest neighbour. Both keep the components and lower the sum of the
    edges' ends, so the rounds come to an end; the graph becomes one star around each component's smallest
    node in a number of rounds that grows with the logarithm of the longest path, and edges that are
    such stars already take none. Minima are taken in every task before the shuffle and joined back,
    so no group is gathered in one row, and the edges of a node with many are joined where they are.
    Edges are written (by ``write``) in each round, so lineage stays short, and what a round no longer needs is deleted.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = write(edges, "edges")
    while True:
        least = write(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "least")
        many, total = least.agg(F.count_if(F.col("k") > 1), F.sum("k")).first()
        lower = least.select(F.col("u").alias("v"), "m")
        if not many and not edges.select("v").distinct().join(lower, "v", "left_semi").limit(1).count():
            roots = least.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
            discard(edges)
            return least.select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(roots)
        hot = hot_rows(total)
        linked = least.select("u", F.col("m").alias("v"))
        wide = None
        if many:
            wide = write(least.where(F.col("k") > hot).select("u"), "hot")
            several = join_spread(edges, least.where("k > 1").select("u", "m"), "u", wide, "inner")
            linked = linked.unionByName(several.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        linked = write(linked, "linked")
        lower = write(linked.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "lower")
        crowded = write(linked.groupBy("v").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("v"), "hot")
        moved = join_spread(linked, lower, "v", crowded, "left").select("u", F.coalesce("m", "v").alias("v"))
        after = write(moved, "edges")
        discard(edges, least, wide, linked, lower, crowded)
        edges = after
