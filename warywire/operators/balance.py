"""Oversampling of the smaller class by interpolation between near neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import hash_rank
from .search import knn_join
from .stats import class_counts


def _hash_number(key: Column, at: int) -> Column:
    """Eight hex digits of an md5 as a number in 0 .. 2**32 - 1."""
    return F.conv(F.substring(key, at, 8), 16, 10).cast("long")


def smote(df: DataFrame, vec: str = "embedding", label: str = "label", k: int = 5, seed: int = 42,
          ident: str = "id") -> DataFrame:
    """Raise the smaller of two classes to parity: (id, vec, label, copy), originals with copy 0.

    The i-th new row starts from a minority row (each serves equally often), moves a
    pseudo-random fraction of the way to one of its k nearest minority neighbours.
    """
    counts = class_counts(df, label, 2)
    minority, majority = min(counts, key=lambda c: (counts[c], c)), max(counts, key=lambda c: (counts[c], c))
    small, need = counts[minority], counts[majority] - counts[minority]
    original = df.select(F.col(ident).alias("id"), F.col(vec).cast("array<double>").alias(vec), F.col(label), F.lit(0).alias("copy"))
    if need == 0 or small < 2:
        return original
    rows = df.filter(F.col(label) == minority).select(F.col(ident).alias("id"), F.col(vec).alias("embedding"))
    near = knn_join(rows.withColumnRenamed("id", "query_id"), rows, k, exclude_self=True)
    picks = min(k, small - 1)
    ranked = hash_rank(rows, [], "id", seed)
    copies = F.lit(need // small) + (F.col("rank") <= need % small).cast("int")
    starts = ranked.withColumn("copies", copies).filter("copies > 0").select(
        "id", "embedding", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("copy").cast("string")))
    starts = starts.withColumn("pick", (_hash_number(key, 1) % picks + 1).cast("int")).withColumn(
        "f", _hash_number(key, 9) / F.lit(4294967296.0))
    chosen = starts.join(near.select(F.col("query_id").alias("id"), F.col("rank").alias("pick"), F.col("id").alias("other")), ["id", "pick"])
    ends = rows.select(F.col("id").alias("other"), F.col("embedding").alias("_to"))
    moved = chosen.join(ends, "other").withColumn(vec, F.transform(
        F.arrays_zip(F.col("embedding").alias("a"), F.col("_to").alias("b")),
        lambda p: p["a"].cast("double") + (p["b"].cast("double") - p["a"].cast("double")) * F.col("f")))
    synthetic = moved.select("id", vec, F.lit(minority).alias(label), "copy")
    return original.unionByName(synthetic)
