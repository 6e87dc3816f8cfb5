"""Directed, weighted interaction graphs: building, PageRank, degree, reports, neighbourhoods.

Edges are (src, dst, weight) with string ids. PageRank keeps the edges in a table bucketed
by source, so a round shuffles ranks and partial sums but never the edges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, materialize
from .ranking import first_edges
from .skew import hot_join


BUCKET_EDGES = 2_000_000  # edges per bucket of the PageRank table


def interactions_to_edges(interactions: DataFrame) -> DataFrame:
    """(sender_id, receiver_id, weight, seq) as (src, dst, weight, seq), weight 1 where it is null."""
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in interactions.columns else F.lit(1)
    return interactions.select(
        F.col("sender_id").cast("string").alias("src"), F.col("receiver_id").cast("string").alias("dst"),
        weight.cast("long").alias("weight"), "seq")


def build_graph(interactions: DataFrame) -> DataFrame:
    """One edge per pair; a repeated pair keeps the weight of its last interaction."""
    edges = interactions_to_edges(interactions)
    return edges.groupBy("src", "dst").agg(F.max_by("weight", "seq").alias("weight"))


def interaction_frequency(interactions: DataFrame) -> DataFrame:
    """One edge per pair, weighted by the number of interactions."""
    return interactions_to_edges(interactions).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Every end of every edge as one row (a self-loop gives two)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def graph_metrics(edges: DataFrame) -> DataFrame:
    """Number of nodes and of edges."""
    ends = endpoints(edges).groupBy("id").agg(F.count("*").alias("n"))  # two for each edge
    return ends.agg(F.count("*").alias("node_count"), F.coalesce((F.sum("n") / 2).cast("long"), F.lit(0)).alias("edge_count"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(in + out) / (n - 1); 1 for a graph of at most one node."""
    degree = endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))
    n = endpoints(edges).agg(F.countDistinct("id")).first()[0]
    if n <= 1:
        return degree.select("id", F.lit(1.0).alias("degree_centrality"))
    return degree.select("id", (F.col("degree") / float(n - 1)).alias("degree_centrality"))


def pagerank(edges: DataFrame, damping: float = 0.85, tol: float = 1e-6, max_iter: int = 100,
             iterations: int | None = None, hub_edges: int = 100_000) -> DataFrame:
    """Weighted PageRank: (id, pagerank).

    A node without outgoing weight spreads its rank evenly over all nodes. Rounds stop when
    the ranks move by less than n * tol in total; more than ``max_iter`` rounds is an error.
    ``iterations`` runs exactly that many rounds instead.

    A source with very many edges is split into parts of about ``hub_edges`` edges; its
    rank is copied once per part, so no task joins all edges of a hub. Each round writes
    the new ranks to the shared folder, which cuts the plan and survives lost executors.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select("src", "dst", "weight"), "pagerank-input")  # read several times below
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism),
                min(-(-edges.count() // BUCKET_EDGES), 50_000))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"), F.count("*").alias("n_out"))
    pieces = F.greatest(F.ceil(F.col("n_out") / hub_edges), F.lit(1)).cast("int")
    nodes = endpoints(edges).distinct().join(out.withColumnRenamed("src", "id"), "id", "left").select(
        "id", (F.coalesce("out", F.lit(0)) == 0).alias("dangling"), F.coalesce(pieces, F.lit(1)).alias("pieces"))
    nodes = materialize(nodes, "pagerank-nodes")
    n = nodes.count()
    if n == 0:
        return spark.createDataFrame([], "id string, pagerank double")

    table = f"pagerank_{uuid.uuid4().hex}"
    shares = hot_join(edges, out.filter("out <> 0"), "src", "dst", hub_edges).select(
        "src", F.pmod(F.xxhash64("dst"), F.ceil(F.col("n_out") / hub_edges)).cast("int").alias("piece"), "dst",
        (F.col("weight") / F.col("out")).alias("share"))
    (shares.repartition(parts, "src", "piece").write.bucketBy(parts, "src", "piece").sortBy("src", "piece")
     .option("path", fresh_path(spark, "pagerank-edges")).saveAsTable(table))
    try:
        links = spark.table(table)
        ranks = nodes.withColumn("pagerank", F.lit(1.0 / n))
        lost = nodes.filter("dangling").count() / n
        for _ in range(iterations if iterations is not None else max_iter):
            sent = ranks.select(F.col("id").alias("src"), "pagerank",
                                F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
            received = links.join(sent, ["src", "piece"]).groupBy(F.col("dst").alias("id")).agg(
                F.sum(F.col("share") * F.col("pagerank")).alias("got"))
            rank = F.lit((1.0 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
            fresh = ranks.withColumnRenamed("pagerank", "old").join(received, "id", "left").select(
                "id", "dangling", "pieces", "old", rank.alias("pagerank"))
            fresh = materialize(fresh, "pagerank-ranks")
            moved, lost = fresh.agg(
                F.sum(F.abs(F.col("pagerank") - F.col("old"))),
                F.coalesce(F.sum(F.when(F.col("dangling"), F.col("pagerank"))), F.lit(0.0))).first()
            ranks = fresh.drop("old")
            if iterations is None and moved < n * tol:
                break
        else:
            if iterations is None:
                raise RuntimeError(f"PageRank did not converge in {max_iter} rounds")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # forgets the name; the files live in the shared folder
    return ranks.select("id", "pagerank")


def graph_report(interactions: DataFrame, max_edges: int | None = None) -> dict[str, DataFrame]:
    """Nodes with both scores, edges, and counts, from all interactions, or from the first ``max_edges``."""
    used = interactions if max_edges is None else first_edges(interactions, max_edges)
    edges = materialize(build_graph(used), "graph")
    return {
        "nodes": pagerank(edges).join(degree_centrality(edges), "id"),
        "edges": edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight"),
        "metrics": graph_metrics(edges),
    }


def ego_network(edges: DataFrame, user_id: str, radius: int = 1) -> DataFrame:
    """Edges among the nodes within ``radius`` steps of a user, in either direction."""
    inside = edges.sparkSession.createDataFrame([(str(user_id),)], "id string")
    for _ in range(radius):
        out = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        into = edges.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        inside = materialize(inside.unionByName(out).unionByName(into).distinct(), "ego")
    kept = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
