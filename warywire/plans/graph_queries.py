"""Registered queries: interaction graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ranking as R
from .inputs import MESSAGES_SQL, messages, table
from .registry import query, tidy


def interactions(spark, sf_dir):
    """Every message is an interaction; a third of them leave the weight out."""
    return messages(spark, sf_dir).select(
        "sender_id", "receiver_id", F.when(F.col("message_id") % 3 != 0, 1 + F.col("message_id") % 4).alias("weight"),
        F.col("message_id").alias("seq"))


def trades(spark, sf_dir):
    """Customer to supplier interactions, one per order line."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.concat(F.lit("c"), "o_custkey").alias("sender_id"), F.concat(F.lit("s"), "l_suppkey").alias("receiver_id"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


INTER_SQL = f"""{MESSAGES_SQL}, inter AS (SELECT CAST(sender_id AS VARCHAR) AS src, CAST(receiver_id AS VARCHAR) AS dst,
   CASE WHEN message_id % 3 = 0 THEN 1 ELSE 1 + message_id % 4 END AS weight, message_id AS seq FROM messages)"""
EDGES_SQL = f"{INTER_SQL}, edges AS (SELECT src, dst, max_by(weight, seq) AS weight FROM inter GROUP BY src, dst)"
TRADES_SQL = """edges AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(*) AS weight
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""
NODES_SQL = "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
DEGREE_SQL = """deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"""


@query("build_interaction_graph", f"WITH {EDGES_SQL} SELECT * FROM edges")
def build_interaction_graph(spark, sf_dir):
    return G.build_graph(interactions(spark, sf_dir))


@query("interaction_frequency", f"WITH {TRADES_SQL} SELECT * FROM edges")
def interaction_frequency(spark, sf_dir):
    return G.interaction_frequency(trades(spark, sf_dir))


@query("graph_metrics", f"WITH {TRADES_SQL}, {NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_metrics(spark, sf_dir):
    return G.graph_metrics(G.interaction_frequency(trades(spark, sf_dir)))


@query("degree_centrality", f"WITH {EDGES_SQL}, {NODES_SQL}, {DEGREE_SQL} SELECT id, round(d / ((SELECT count(*) FROM nodes) - 1), 6) AS degree_centrality FROM deg")
def degree_centrality(spark, sf_dir):
    return tidy(G.degree_centrality(G.build_graph(interactions(spark, sf_dir))))


def rounds_sql(n: int) -> str:
    """n unrolled PageRank rounds over `edges` and `nodes`; the last is `r{n}`."""
    ctes = ["outw AS (SELECT src, sum(weight) AS w FROM edges GROUP BY src)",
            "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(n):
        ctes.append(f"""r{i + 1} AS MATERIALIZED (SELECT p.id, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85 * (
   (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM outw)) / (SELECT count(*) FROM nodes)
   + coalesce(g.got, 0)) AS r FROM r{i} p LEFT JOIN (SELECT e.dst AS id, sum(q.r * e.weight / o.w) AS got
   FROM edges e JOIN outw o USING (src) JOIN r{i} q ON q.id = e.src GROUP BY e.dst) g ON g.id = p.id)""")
    return ", ".join(ctes)


@query("pagerank", f"WITH {EDGES_SQL}, {NODES_SQL}, {rounds_sql(5)} SELECT id, round(r, 9) AS pagerank FROM r5")
def pagerank(spark, sf_dir):
    return tidy(G.pagerank(G.build_graph(interactions(spark, sf_dir)), iterations=5), 9)


@query("pagerank_trades", f"WITH {TRADES_SQL}, {NODES_SQL}, {rounds_sql(4)} SELECT id, round(r, 9) AS pagerank FROM r4")
def pagerank_trades(spark, sf_dir):
    return tidy(G.pagerank(G.interaction_frequency(trades(spark, sf_dir)), iterations=4, hub_edges=50), 9)


@query("pagerank_converged", f"WITH {EDGES_SQL}, {NODES_SQL}, {rounds_sql(40)} SELECT id, round(r, 3) AS pagerank FROM r40")
def pagerank_converged(spark, sf_dir):
    return tidy(G.pagerank(G.build_graph(interactions(spark, sf_dir))), 3)


_ALL_SQL = f"""{INTER_SQL}, used AS (SELECT * FROM inter),
 edges AS (SELECT src, dst, max_by(weight, seq) AS weight FROM used GROUP BY src, dst), {NODES_SQL}"""


@query("first_n_interactions", f"WITH {INTER_SQL} SELECT src, dst, weight, seq FROM inter ORDER BY seq LIMIT 10")
def first_n_interactions(spark, sf_dir):
    return R.first_edges(G.interactions_to_edges(interactions(spark, sf_dir)), 10)


@query("graph_report", f"""WITH {_ALL_SQL}, {DEGREE_SQL}, {rounds_sql(40)}
 SELECT 'node' AS kind, r40.id AS a, NULL AS b, round(r, 3) AS pagerank, round(d / ((SELECT count(*) FROM nodes) - 1), 6) AS degree, NULL AS weight
  FROM r40 JOIN deg ON deg.id = r40.id
 UNION ALL SELECT 'edge', src, dst, NULL, NULL, weight FROM edges
 UNION ALL SELECT 'metrics', CAST((SELECT count(*) FROM nodes) AS VARCHAR), CAST((SELECT count(*) FROM edges) AS VARCHAR), NULL, NULL, NULL""")
def graph_report(spark, sf_dir):
    rep = G.graph_report(interactions(spark, sf_dir))
    no = F.lit(None)
    nodes = rep["nodes"].select(F.lit("node").alias("kind"), F.col("id").alias("a"), no.cast("string").alias("b"),
                                F.round("pagerank", 3).alias("pagerank"), F.round("degree_centrality", 6).alias("degree"),
                                no.cast("long").alias("weight"))
    edges = rep["edges"].select(F.lit("edge"), "source", "target", no.cast("double"), no.cast("double"), "weight")
    counts = rep["metrics"].select(F.lit("metrics"), F.col("node_count").cast("string"), F.col("edge_count").cast("string"),
                                   no.cast("double"), no.cast("double"), no.cast("long"))
    return nodes.union(edges).union(counts)


@query("top_nodes", f"WITH {TRADES_SQL}, {NODES_SQL}, {rounds_sql(3)} SELECT id, round(r, 9) AS pagerank FROM r3 ORDER BY round(r, 9) DESC, id LIMIT 3")
def top_nodes(spark, sf_dir):
    ranks = tidy(G.pagerank(G.interaction_frequency(trades(spark, sf_dir)), iterations=3), 9)
    return R.top_nodes(ranks, 3)


@query("ego_network", f"""WITH {EDGES_SQL}, inside AS (SELECT '7' AS id UNION SELECT dst FROM edges WHERE src = '7' UNION SELECT src FROM edges WHERE dst = '7')
 SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)""")
def ego_network(spark, sf_dir):
    return G.ego_network(G.build_graph(interactions(spark, sf_dir)), "7")
