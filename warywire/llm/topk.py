"""Exact top-k search by integer inner product: tiled matrix products and merged top lists.

Rows are dealt into shards and queries into blocks; every (shard, block) pair is a tile that one
task multiplies as matrices. A tile keeps only the k best rows of each of its queries, and the
tiles' lists are merged in two levels: first groups of tiles, then the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
TILE_ROWS = 4096
TILE_QUERIES = 4096
FAN_IN = 16
FLOAT_EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of float64 arrays that hold integers, as int64.

    Sums that doubles hold exactly are multiplied as doubles; larger ones in Python integers, and
    values beyond a long are held at its limits.
    """
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1])
    if bound < FLOAT_EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(rows).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, ties to smaller ids; ids ascend."""
    n = scores.shape[1]
    if n > k:
        edge = np.partition(scores, n - k, axis=1)[:, n - k]
        keep = scores >= edge[:, None]
        out = np.zeros((len(scores), k), np.int64)
        for i in range(len(scores)):  # ties at the edge may leave a few more than k
            at = np.flatnonzero(keep[i])
            out[i] = at[np.argsort(-scores[i, at], kind="stable")[:k]]
        return out
    return np.argsort(-scores, axis=1, kind="stable")


def search(vectors: DataFrame, queries: Column, k: int = K, ident: str = "vec_id", vector: str = "embedding",
           scale: int = SCALE, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """The k rows of highest integer inner product for every row that fits ``queries``.

    Components become floor(scale * x), x as double. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller vec_id; a query's own row is no candidate (rows that repeat its id neither),
    fewer candidates give fewer rows. Vectors that are null or hold null or non-finite components take
    no part; vectors of different length don't meet. A null id takes no part. A repeated query row is
    answered once. Empty table: no rows. Other columns are not read.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    rows = vectors.filter(usable(F.col(vector)) & F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("id"), whole.alias("v"), F.size(vector).alias("dim"),
        queries.alias("asked"))
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    shards, blocks = max(1, math.ceil(n / tile_rows)), max(1, math.ceil(asked / tile_queries))
    # Equal ids are dealt by place too, so that a repeated id spreads.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)))
    left = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("shard", "block", "dim", "id", "v")
    right = (
        rows.filter("asked").select("id", "v", "dim").dropDuplicates(["id", "v"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        .select("shard", "block", F.col("dim").alias("dim"), F.col("id").alias("query"), F.col("v").alias("q"))
    )

    def tile(key, rows_of: pd.DataFrame, queries_of: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "tile": []}).astype("int64")
        if rows_of.empty or queries_of.empty:
            return empty
        rows_of = rows_of.sort_values("id", kind="stable")
        ids, data = rows_of["id"].to_numpy(), np.stack(rows_of["v"].to_numpy())
        out = []
        for at in range(0, len(queries_of), 512):
            part = queries_of.iloc[at:at + 512]
            scores = products(np.stack(part["q"].to_numpy()), data)
            own = ids[None, :] == part["query"].to_numpy()[:, None]
            take = min(len(ids), k + int(own.sum(axis=1).max(initial=0)))
            at_best = best(scores, ids, take)
            kept = ~np.take_along_axis(own, at_best, 1)
            out.append(pd.DataFrame({
                "query_id": np.repeat(part["query"].to_numpy(), at_best.shape[1])[kept.ravel()],
                "vec_id": ids[at_best].ravel()[kept.ravel()],
                "score": np.take_along_axis(scores, at_best, 1).ravel()[kept.ravel()]}))
        return pd.concat(out).assign(tile=int(key[0]))

    lists = left.groupBy("shard", "block", "dim").cogroup(right.groupBy("shard", "block", "dim")).applyInPandas(
        tile, "query_id long, vec_id long, score long, tile long")
    order = [F.desc("score"), F.asc("vec_id")]
    rank = F.row_number()
    merged = (
        lists.withColumn("part", F.floor(F.col("tile") / FAN_IN))
        .withColumn("rank", rank.over(Window.partitionBy("query_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
        if shards > FAN_IN else lists
    )
    return (
        merged.withColumn("rank", rank.over(Window.partitionBy("query_id").orderBy(*order)).cast("int"))
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def oracle(k: int = K, every: int = 100) -> str:
    return f"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
