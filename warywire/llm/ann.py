"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (random signs and Hadamard transforms, three times) turns a unit vector, and
the signed axis nearest to it is its bucket. Several tables with own signs are built; a query probes
the few nearest axes of each table, and what it meets there is reranked by exact cosine.

Equal vectors are indexed once, so a vector that fills a third of the table is one entry. Buckets of
any size are read whole: a large one is dealt out over several tasks. For large tables a second,
smaller polytope refines the buckets, and the number of tables grows as the theory asks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, materialize
from .topk import usable

K = 5
TABLES = 8
PROBES = 16
SEED = 29
PART_ROWS = 4096
FINE_FROM = 2**20


def settings(rows: int, tables: int = TABLES) -> tuple[int, int]:
    """(tables, dimension of the second polytope or 0) for so many vectors.

    From ``FINE_FROM`` rows on the second polytope doubles with the table, so buckets stay as they are, and the
    tables grow with the 0.3rd power of the buckets.
    """
    fine = 2 ** int(math.log2(rows / FINE_FROM)) if rows >= 2 * FINE_FROM else 0
    return (math.ceil(tables * (2 * fine) ** 0.3) if fine else tables), fine


def rotate(unit: np.ndarray, table: int, step: int = 0, seed: int = SEED) -> np.ndarray:
    """A fast pseudo-rotation of the rows, whose length is a power of two."""
    n, dim = unit.shape
    signs = np.random.default_rng([seed, table, step]).choice([-1.0, 1.0], (3, dim))
    out = unit
    for flip in signs:
        out = out * flip
        half = 1
        while half < dim:
            pairs = out.reshape(n, -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, dim)
            half *= 2
        out = out / math.sqrt(dim)
    return out


def axes(rotated: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of each row, nearest first, and how much nearer the first one is."""
    signed = np.round(np.concatenate([rotated, -rotated], axis=1), 12)  # equal axes in a fixed order
    probes = min(probes, signed.shape[1])
    order = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
    value = np.take_along_axis(signed, order, 1)
    return order, value[:, :1] - value


def codes(vectors: np.ndarray, tables: int, fine: int, probes: int) -> np.ndarray:
    """Buckets to look into: (rows, tables, probes), nearest first; the first is the row's own."""
    n, dim = vectors.shape
    wide = np.zeros((n, 1 << max(0, (dim - 1).bit_length())))
    wide[:, :dim] = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = []
    for table in range(tables):
        first, gap = axes(rotate(wide, table), probes)
        if not fine:
            out.append(first)
            continue
        second, gap2 = axes(rotate(wide, table, 1)[:, :fine], probes)
        cost = (gap[:, :, None] + gap2[:, None, :]).reshape(n, -1)
        both = (first[:, :, None] * (2 * fine) + second[:, None, :]).reshape(n, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out.append(np.take_along_axis(both, best, 1))
    least = min(o.shape[1] for o in out)
    return np.stack([o[:, :least] for o in out], 1)


def hashed(vectors: DataFrame, tables: int, fine: int, probes: int) -> DataFrame:
    """Adds ``cells``, array<array<int>>: per table the buckets to look into."""

    def run(batches):
        for pdf in batches:
            cells = pd.Series(index=pdf.index, dtype=object)
            for _, part in pdf.groupby("dim"):
                found = codes(np.stack(part["v"].to_numpy()).astype(np.float64), tables, fine, probes)
                cells.loc[part.index] = pd.Series([c.tolist() for c in found], index=part.index)
            yield pdf.assign(cells=cells)

    return vectors.mapInPandas(run, "vid long, v array<float>, dim int, cells array<array<int>>")


def search(vectors: DataFrame, queries: Column, k: int = K, ident: str = "vec_id", vector: str = "embedding",
           tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """For each row that fits ``queries`` its k rows of highest cosine among those in the probed buckets.

    Returns query_id, rank (from 1), vec_id, score (the exact cosine of the original vectors in double
    precision); ties go to the smaller vec_id; rows with the query's own id are no candidates. Vectors that
    are null, zero, or hold null or non-finite components, and null ids, take no part; vectors of
    different length don't meet. Repeated rows: equal ids count once per distinct vector. Empty table:
    no rows. Other columns are not read.
    """
    norm = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.filter(usable(F.col(vector)) & F.col(ident).isNotNull()).filter(norm > 0).select(
        F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), queries.alias("asked"))
    # The k + 1 smallest ids of each distinct vector are all that a top list can need of its copies.
    smallest = Window.partitionBy("v").orderBy("id")
    kept = rows.select("id", "v").withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
    distinct = materialize(kept.groupBy("v").agg(F.min("id").alias("vid"), F.array_sort(F.collect_list("id")).alias("ids")), "ann-vectors")
    tables, fine = settings(distinct.count(), tables)
    plain = distinct.select("vid", "v", F.size("v").alias("dim"))
    index = materialize(hashed(plain, tables, fine, 1).select(
        "vid", "v", "dim", F.transform("cells", lambda c: c[0]).alias("cells")), "ann-index")
    asked = rows.filter("asked").groupBy("v").agg(F.min("id").alias("vid"))
    probed = hashed(asked.select("vid", "v", F.size("v").alias("dim")), tables, fine, probes)

    entries = index.select("dim", F.posexplode("cells").alias("table", "cell"), "vid", "v")
    parts = entries.groupBy("dim", "table", "cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    parts = bounded_broadcast(parts)  # buckets are bounded by the settings, not by the rows
    dealt = entries.join(parts, ["dim", "table", "cell"]).select(
        "dim", "table", "cell", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"), "vid", "v")
    looked = (
        probed.select("dim", F.posexplode("cells").alias("table", "found"), "vid", "v")
        .select("dim", "table", F.explode("found").alias("cell"), "vid", "v")
        .join(parts, ["dim", "table", "cell"])
        .select("dim", "table", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vid", "v")
    )

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "vid": [], "score": []}).astype({"query": "int64", "vid": "int64"})
        left = left.sort_values("vid", kind="stable")
        ids, data = left["vid"].to_numpy(), _unit(left["v"])
        out = []
        for at in range(0, len(right), 512):
            part = right.iloc[at:at + 512]
            scores = _unit(part["v"]) @ data.T
            take = min(k + 1, scores.shape[1])
            edge = np.partition(scores, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
            q, c = np.nonzero(scores >= edge[:, None])
            order = np.lexsort((ids[c], -scores[q, c], q))
            q, c = q[order], c[order]
            first = np.searchsorted(q, np.arange(len(part)))
            kept = np.arange(len(q)) - first[q] < take
            q, c = q[kept], c[kept]
            out.append(pd.DataFrame({"query": part["vid"].to_numpy()[q], "vid": ids[c], "score": scores[q, c]}))
        return pd.concat(out)

    keys = ["dim", "table", "cell", "part"]
    met = dealt.groupBy(*keys).cogroup(looked.groupBy(*keys)).applyInPandas(rerank, "query long, vid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vid"))
    near = (
        met.groupBy("query", "vid").agg(F.max("score").alias("score"))
        .withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
        .join(distinct.select("vid", F.explode("ids").alias("vec_id")), "vid").select("query", "vec_id", "score")
    )
    asking = rows.filter("asked").select("id", "v").distinct().join(
        asked.withColumnRenamed("vid", "query"), "v").select(F.col("id").alias("query_id"), "query")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        asking.join(near, "query").filter(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(rank).cast("int")).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    data = np.stack(vectors.to_numpy()).astype(np.float64)
    return data / np.linalg.norm(data, axis=1)[:, None]
