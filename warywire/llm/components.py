"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _lightest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each node; aggregated before it is shuffled, so hubs don't matter."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); the root is the smallest node reachable.

    Each round points the larger neighbours of every node at its smallest neighbour and then the
    smaller ones, which keeps the components and soon leaves stars. A hub's links are joined with one
    row, so a hot key is a skewed join that Spark splits, never a group in one task. Nodes are compared
    in their type's order. Every round is written to the shared folder. No links: no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    state = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _lightest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = _lightest(large)
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.filter("u <> v").distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.min("u")).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError("the links did not settle")
