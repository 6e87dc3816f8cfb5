import math

import numpy as np
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from warywire.llm import ann, topk
from warywire.llm.common import table
from warywire.llm.queries import op4_cross_polytope, op9_top_products

BAD = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 0.0]), (None, [1.0, 0.0])]


def read(spark, sf):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def nearest(ids, data, query, k, measure):
    scores = measure(data, data[np.searchsorted(ids, query)])
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), scores[i]) for i in order if ids[i] != query][:k]


def cosine(data, q):
    return data @ q / (np.linalg.norm(data, axis=1) * np.linalg.norm(q))


def test_ann_recall_and_exact_scores(spark):
    ids, data = read(spark, "/root/testdata/sf0.1")
    rows = op4_cross_polytope(spark, "/root/testdata/sf0.1").collect()
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        found = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        want = nearest(ids, data, q, 5, cosine)
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        scores = cosine(data, data[np.searchsorted(ids, q)])
        assert all(r.score == pytest.approx(scores[np.searchsorted(ids, r.vec_id)], abs=1e-12) for r in found)
        hit += len({r.vec_id for r in found} & {i for i, _ in want})
        total += len(want)
    assert hit / total >= 0.9


def test_ann_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(50 + i, [2.0, 0.0]) for i in range(3)] + [(100, [0.0, 0.0]), (101, [0.0, 1.0])] + BAD
    out = ann.search(vectors(spark, *rows).withColumn("id", F.lit(1)).withColumn("v", F.lit(2)), F.col("vec_id").isin(0, 7, 100, 101, 900), k=5, probes=4)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[7] == [0, 1, 2, 3, 4]
    assert set(got) <= {0, 7, 101}


def test_ann_fewer_candidates_and_empty(spark):
    few = vectors(spark, (0, [1.0, 2.0]), (1, [1.0, 2.1]), (2, [1.0, 2.0, 3.0]))
    assert [(r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.search(vectors(spark).filter("false") if False else spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_finer_hash_for_large_tables():
    assert ann.settings(2**20) == (ann.TABLES, 0)
    tables, fine = ann.settings(2**24)
    assert fine == 16 and tables > ann.TABLES
    data = np.random.default_rng(1).normal(size=(50, 6))
    cells = ann.codes(data, 3, 4, 10)
    assert cells.shape == (50, 3, 10) and all(len(set(c)) == 10 for row in cells for c in row.tolist())
    assert (ann.codes(data * 5, 3, 4, 1) == cells[:, :, :1]).all()


def test_rotation_keeps_lengths():
    data = np.random.default_rng(2).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.rotate(data, 3), axis=1), np.linalg.norm(data, axis=1))


def test_top_products_against_brute_force(spark, sf):
    ids, data = read(spark, sf)
    whole = np.floor(1024 * data).astype(np.int64)
    rows = op9_top_products(spark, sf).collect()
    for q in ids[ids % 100 == 0]:
        want = nearest(ids, whole, q, 10, lambda d, x: d @ x)
        assert [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] == [(i, int(s)) for i, s in want]


def test_top_products_tiles_merge_alike(spark, sf):
    table_ = table(spark, sf, "embeddings")
    whole = topk.search(table_, F.col("vec_id") % 100 == 0)
    tiled = topk.search(table_, F.col("vec_id") % 100 == 0, tile_rows=16, tile_queries=2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tiled.collect()))


def test_top_products_edges(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(5, [0.0, 0.0]), (6, [-1.0, 0.5]), (7, [3e38, 3e38]), (8, [1.0, 2.0, 3.0])] + BAD
    out = topk.search(vectors(spark, *rows).withColumn("id", F.lit(0)).withColumn("shard", F.lit(0)), F.col("vec_id").isin(0, 5, 7, 8, 902), k=3)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0][1:] == [(1, 1024 * 1024), (2, 1024 * 1024)] and got[0][0][0] == 7
    assert [i for i, _ in got[5]] == [0, 1, 2] and 8 not in got and set(got) == {0, 5, 7}
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0**31 + 1, 1.0]])
    assert topk.products(a, a)[0, 0] == (2**31 + 1) ** 2 + 1
    assert topk.products(a * 2.0**20, a * 2.0**20)[0, 0] == 2**63 - 1
    assert math.isfinite(topk.products(a, -a)[0, 0])
