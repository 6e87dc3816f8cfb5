"""Search, oversampling and graphs against brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from warywire.operators import balance as B
from warywire.operators import graph as G
from warywire.operators import search as SE


def vectors(spark, rows, ident="id"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"{ident} long, embedding array<float>")


@pytest.fixture(scope="module")
def points():
    """A third of the rows are copies of one vector, the rest form clusters."""
    rng = random.Random(11)
    hot = [0.5] * 4
    rows = []
    for i in range(240):
        if i % 3 == 0:
            rows.append(hot)
        else:
            c = i % 5
            rows.append([float(np.float32(c + rng.gauss(0, 0.2))) for _ in range(4)])
    return rows


def brute(queries, corpus, k, exclude_self):
    q, c = np.array(queries, dtype=np.float64), np.array(corpus, dtype=np.float64)
    out = {}
    for i, v in enumerate(q):
        d = [(float(((v - w) ** 2).sum()), j) for j, w in enumerate(c) if not (exclude_self and i == j)]
        out[i] = [j for _, j in sorted(d)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("limit", [4096, 0])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_join_is_exact(spark, points, limit, exclude_self):
    corpus = vectors(spark, points)
    got = found(SE.knn_join(corpus.withColumnRenamed("id", "query_id"), corpus, 6, exclude_self, limit))
    assert got == brute(points, points, 6, exclude_self)


def test_cell_join_in_small_blocks(spark, points):
    corpus = vectors(spark, points).select("id", "embedding")
    hits = SE._many_queries(corpus.withColumnRenamed("id", "query_id"), corpus, 4, block=7, chunk=11)
    assert found(SE._rank(hits, 4)) == brute(points, points, 4, False)


def test_knn_with_k_above_corpus(spark):
    corpus = vectors(spark, [[0.0, 1.0], [1.0, 0.0]])
    for limit in (10, 0):
        got = found(SE.knn_join(corpus.withColumnRenamed("id", "query_id"), corpus, 5, True, limit))
        assert got == {0: [1], 1: [0]}


def search_corpus(spark):
    rows = [(i, [float(i // 4), 0.0], f" Text {i // 4}".upper() if i % 2 else f"text {i // 4} ", "A" if i < 20 else "B",
             "high" if i % 2 else "low") for i in range(40)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, document string, platform string, risk_level string")


def test_search_overfetch_and_exact(spark):
    q = spark.createDataFrame([("q", [0.0, 0.0])], "query_id string, embedding array<double>")
    few = SE.semantic_search(search_corpus(spark), q, 3, overfetch=2).orderBy("rank").collect()
    assert [r["id"] for r in few] == [0, 4]  # six fetched rows hold two texts only
    full = SE.semantic_search(search_corpus(spark), q, 3, overfetch=None).orderBy("rank").collect()
    assert [r["id"] for r in full] == [0, 4, 8]
    assert full[1]["similarity_score"] == pytest.approx(0.5)
    filtered = SE.semantic_search(search_corpus(spark), q, 2, "B", "high").collect()
    assert {(r["platform"], r["risk_level"]) for r in filtered} == {("B", "high")}
    assert SE.semantic_search(search_corpus(spark), q, None).count() == 5


def test_ann_recall(spark, points, tmp_path):
    corpus = vectors(spark, points)
    pivots = SE.write_cells(corpus, str(tmp_path / "cells"), 12)
    queries = corpus.withColumnRenamed("id", "query_id")
    stored = spark.read.parquet(str(tmp_path / "cells"))
    exact = found(SE.knn_join(queries, corpus, 5))
    near = found(SE.ann_search(stored, pivots, queries, 5, probes=4))
    recall = np.mean([len(set(near[i]) & set(exact[i])) / 5 for i in exact])
    assert recall > 0.8
    assert found(SE.ann_search(stored, pivots, queries, 5, probes=12)) == exact
    assert found(SE.ann_search(stored, pivots, queries, 5, probes=4, broadcast_limit=10)) == near


def test_texts_that_differ_in_outer_white_space_are_one(spark):
    rows = [(0, [0.0], "buy weed\n"), (1, [0.1], "Buy weed"), (2, [0.2], "\tbuy weed\u00a0"), (3, [0.3], "buy  weed")]
    corpus = spark.createDataFrame([(*r, "A", "high") for r in rows], "id long, embedding array<float>, document string, platform string, risk_level string")
    q = spark.createDataFrame([("q", [0.0])], "query_id string, embedding array<double>")
    for overfetch in (None, 5):
        hits = SE.semantic_search(corpus, q, 4, overfetch=overfetch).orderBy("rank").collect()
        assert [r["id"] for r in hits] == [0, 3]


def test_many_copies_do_not_hide_other_texts(spark):
    rows = [(i, [0.0], "copy") for i in range(500)] + [(500 + i, [1.0 + i], f"text {i}") for i in range(5)]
    corpus = spark.createDataFrame([(*r, "A", "high") for r in rows], "id long, embedding array<float>, document string, platform string, risk_level string")
    q = spark.createDataFrame([("q", [0.0])], "query_id string, embedding array<double>")
    assert [r["id"] for r in SE.semantic_search(corpus, q, 5).orderBy("rank").collect()] == [0, 500, 501, 502, 503]


def test_smote_reaches_parity_inside_the_class(spark, points):
    df = vectors(spark, points).withColumn("label", (F.col("id") % 6 == 1).cast("int"))
    out = B.smote(df).collect()
    counts = {}
    for r in out:
        counts[r["label"]] = counts.get(r["label"], 0) + 1
    assert counts[0] == counts[1] == 200
    box = np.array([v for i, v in enumerate(points) if i % 6 == 1])
    made = np.array([r["embedding"] for r in out if r["copy"] > 0])
    assert (made >= box.min(0) - 1e-6).all() and (made <= box.max(0) + 1e-6).all()


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight long")


def dense_pagerank(rows, rounds=200, d=0.85):
    ids = sorted({x for a, b, _ in rows for x in (a, b)})
    n, at = len(ids), {x: i for i, x in enumerate(ids)}
    w = np.zeros((n, n))
    for a, b, v in rows:
        w[at[a], at[b]] = v
    out = w.sum(1)
    r = np.full(n, 1 / n)
    for _ in range(rounds):
        r = (1 - d) / n + d * ((w / np.where(out, out, 1)[:, None]).T @ r + r[out == 0].sum() / n)
    return dict(zip(ids, r))


def test_pagerank_chain_golden(spark):
    got = {r["id"]: r["pagerank"] for r in G.pagerank(edges(spark, [("u1", "u2", 5), ("u2", "u3", 2)])).collect()}
    assert got["u1"] == pytest.approx(0.18442, abs=1e-4)
    assert got["u2"] == pytest.approx(0.34117, abs=1e-4)
    assert got["u3"] == pytest.approx(0.47441, abs=1e-4)


@pytest.mark.parametrize("hub_edges", [100_000, 3])
def test_pagerank_against_dense(spark, hub_edges):
    rng = random.Random(5)
    pairs = {("hub", f"n{i}") for i in range(25)} | {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(60)}
    rows = [(a, b, rng.randrange(0, 4)) for a, b in sorted(pairs)]  # with self-loops, zero weights and dangling nodes
    got = {r["id"]: r["pagerank"] for r in G.pagerank(edges(spark, rows), tol=1e-10, hub_edges=hub_edges).collect()}
    want = dense_pagerank(rows)
    assert sum(got.values()) == pytest.approx(1.0)
    assert got == pytest.approx(want, abs=1e-8)


def test_pagerank_fails_without_convergence(spark):
    with pytest.raises(RuntimeError):
        G.pagerank(edges(spark, [("a", "b", 1), ("b", "c", 1)]), tol=1e-15, max_iter=2)


def test_repeated_edge_last_weight_wins_and_self_loop(spark):
    inter = spark.createDataFrame([("a", "b", 1, 1), ("a", "b", 9, 2), ("a", "a", None, 3)],
                                  "sender_id string, receiver_id string, weight int, seq long")
    built = {(r["src"], r["dst"]): r["weight"] for r in G.build_graph(inter).collect()}
    assert built == {("a", "b"): 9, ("a", "a"): 1}
    deg = {r["id"]: r["degree_centrality"] for r in G.degree_centrality(G.build_graph(inter)).collect()}
    assert deg == {"a": 3.0, "b": 1.0}


def test_single_node(spark):
    loop = edges(spark, [("a", "a", 1)])
    assert G.degree_centrality(loop).first()["degree_centrality"] == 1.0
    assert G.pagerank(loop).first()["pagerank"] == pytest.approx(1.0)


def test_graph_report_uses_first_ten(spark):
    inter = spark.createDataFrame([(f"s{i}", f"r{i}", 1, i) for i in range(30)],
                                  "sender_id string, receiver_id string, weight int, seq long")
    rep = G.graph_report(inter, 10)
    assert rep["edges"].count() == 10 and rep["metrics"].first()["node_count"] == 20
    assert G.graph_report(inter)["edges"].count() == 30


def test_ego_radius(spark):
    chain = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("x", "y", 1)])
    assert G.ego_network(chain, "b").count() == 2
    assert G.ego_network(chain, "b", radius=2).count() == 3
    assert G.ego_network(chain, "nobody").count() == 0


def test_hot_join_equals_plain_join(spark):
    from warywire.operators.skew import hot_join
    left = spark.range(900).select(F.col("id").alias("q"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"))
    right = spark.createDataFrame([(i, f"v{j}") for i in range(45) for j in range(2)], "k long, v string")
    got = hot_join(left, right, "k", "q", min_rows=50)
    want = left.join(right, "k")
    assert got.count() == want.count() and got.select("q", "k", "v").exceptAll(want.select("q", "k", "v")).count() == 0
