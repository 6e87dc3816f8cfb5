"""Splits, folds, samples, top-k and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .conform import misclassified
from .ordered import hash_rank


def stratified_split(df: DataFrame, label: str = "label", test: float = 0.2, seed: int = 42,
                     ident: str = "message_id") -> DataFrame:
    """Adds split = 'train' or 'val'; each label gives the same share to 'val'."""
    ranked = hash_rank(df, [label], ident, seed)
    share = F.round(F.col("group_rows") * test)
    return ranked.withColumn("split", F.when(F.col("rank") <= share, "val").otherwise("train")).drop("rank", "group_rows")


def with_folds(df: DataFrame, label: str = "label", k: int = 5, seed: int = 42, ident: str = "message_id") -> DataFrame:
    """Adds fold in 0..k-1, balanced within each label."""
    ranked = hash_rank(df, [label], ident, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "group_rows")


def top_errors(preds: DataFrame, kind: str, n: int = 5, ident: str = "message_id") -> DataFrame:
    """The most confident false positives, or the least confident false negatives."""
    order = F.col("probability").desc() if kind == "fp" else F.col("probability").asc()
    return misclassified(preds, kind).orderBy(order, ident).limit(n)


def top_importances(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.col("importance").desc(), "feature").limit(n)


def top_nodes(nodes: DataFrame, n: int = 3) -> DataFrame:
    return nodes.orderBy(F.col("pagerank").desc(), "id").limit(n)


def first_edges(edges: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """Only the first n interactions in input order."""
    return edges.orderBy(order).limit(n)


def text_key(text: Column) -> Column:
    """What makes two texts the same: the text without case and outer white space."""
    return F.btrim(F.lower(text), F.lit(V.SPACE_CHARS))


def dedup_hits(hits: DataFrame, limit: int | None = None, query: str = "query_id",
               text: str = "document", dist: str = "distance", ident: str = "id") -> DataFrame:
    """Per query, keep the nearest hit of each text (case and outer white space ignored), then cut to ``limit``.

    The nearest hit per text is a ``min`` aggregate with map-side combine, so copies of one
    text never meet in one sort; Spark cuts the ranking that follows within each partition.
    """
    rest = [c for c in hits.columns if c not in (query, dist, ident, "rank")]
    best = F.min(F.struct(dist, ident, *rest)).alias("_best")
    kept = hits.groupBy(query, text_key(F.col(text)).alias("_t")).agg(best).select(query, "_best.*")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(dist, ident)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Counts per value, nulls kept, most frequent first."""
    out = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(col).asc_nulls_last())
    return out if n is None else out.limit(n)


def value_counts_of(df: DataFrame, cols: Sequence[str], n: int | None = None) -> DataFrame:
    """(col, val, n) for several columns, counted in one pass; with ``n`` the most frequent values of each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in cols])
    counts = df.select(F.inline(pairs)).groupBy("col", "val").agg(F.count("*").alias("n"))
    if n is None:
        return counts
    order = Window.partitionBy("col").orderBy(F.desc("n"), F.col("val").asc_nulls_last())
    return counts.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_place")


def label_distribution(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Label counts for the whole set ('all') and per split, in one pass."""
    both = F.explode(F.array(F.lit("all"), F.col(split)))
    return df.select(both.alias("part"), label).groupBy("part", label).agg(F.count("*").alias("n"))


