"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums, whole epochs first.

Every document gets the key ``-ln(u) / quality``; the smallest keys of a source are a weighted
sample without replacement. A source that must give more words than it has repeats all its
documents (complete epochs); the fraction that remains goes to the documents in key order until
the budget is used up. Where the order is cut is found from the sums of key buckets and one sort
of the bucket that holds the cut, so no task sorts a source, and documents are never shuffled:
they meet a table of one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, materialize
from .common import same, unit_hash, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
BUCKETS = 4096


def quality(text: Column, size: Column) -> Column:
    """0.5 to 1: highest where the words' mean length is that of natural text."""
    length = F.length(text) / size
    near = (length - F.lit(7.0)) / F.lit(3.0)
    return F.when(size > 0, F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + near * near)).otherwise(F.lit(0.5))


def mix_key(doc_id: Column, text: Column, weight: Column, seed: int = SEED) -> Column:
    """The exponential key. Repeated rows have equal keys."""
    return -F.log(unit_hash(F.lit(seed), doc_id, F.length(text))) / weight


def keyed(docs: DataFrame, row: str, seed: int) -> DataFrame:
    """Adds source, size and key of the documents in the struct column ``row``, in one pass over the text."""
    text = F.col(f"{row}.text")
    return docs.withColumn("size", word_count(text)).withColumn("source", F.col(f"{row}.source")).withColumn(
        "key", mix_key(F.col(f"{row}.doc_id"), text, quality(text, F.col("size")), seed))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight of all sizes, none above
    ``cap`` times its size, the excess reshared by weight.

    Sources in code-point order (null last) take the weights in turn. With sources ordered by
    cap / weight, those before some place are full and the others share what is left evenly
    by weight; prefix sums find that level without iterating. One row per source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(place) - 1) % len(weights) + 1
    ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.sum("_w").over(rest))
        .withColumn("_level", F.max("_level").over(everything))  # it rises while sources are full, then falls
        .select("source", "source_size", F.least("_cap", F.coalesce("_level", F.lit(0.0)) * F.col("_w")).alias("target"))
    )


def mix_plan(base: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, buckets: int = BUCKETS) -> DataFrame:
    """One row per source: its size, target, whole epochs and where the key order is cut.

    ``base`` has source, size and key. Rows with equal keys (repeated rows) at the cut share
    what is left evenly.
    """
    bucket = F.floor(F.lit(buckets) * (1 - F.exp(-F.col("key")))).cast("int")
    sums = materialize(base.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words")), "mix-sums")
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = source_targets(sources, weights, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = materialize(plan, "mix-targets")
    upto = Window.partitionBy("source").orderBy("b")
    edge = (
        sums.withColumn("cum", F.sum("words").over(upto))
        .withColumnRenamed("source", "_s").join(bounded_broadcast(plan.select("source", "rest")), same("_s", "source"))
        .filter((F.col("rest") > 0) & (F.col("cum") >= F.col("rest")) & (F.col("cum") - F.col("words") < F.col("rest")))
        .select("source", "b", "rest", (F.col("cum") - F.col("words")).alias("below"))
    )
    edge = bounded_broadcast(edge.select(F.col("source").alias("_s"), F.col("b").alias("_b"), "rest", "below"))
    near = (
        base.join(edge, same("source", "_s") & (bucket == F.col("_b")))
        .groupBy("source", "key", "rest", "below").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
        .withColumn("upto", F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("key")))
        .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        .select(F.col("source").alias("_s"), F.col("key").alias("cut"),
                F.floor((F.col("rest") - F.col("upto") + F.col("words")) / F.col("ties")).alias("cut_words"))
    )
    return materialize(plan.join(near, same("source", "_s"), "left").drop("_s"), "mix-plan")


def with_plan(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins each row of ``base`` (source, size, key and others) with its source's plan and adds
    ``part``, the words it gives to the fractional pass, and ``taken``."""
    side = bounded_broadcast(plan.withColumnRenamed("source", "_s"))
    part = F.when(F.col("key") < F.col("cut"), F.col("size")).when(
        F.col("key") == F.col("cut"), F.least("size", "cut_words")).otherwise(0).cast("long")
    return (
        base.join(side, same("source", "_s"), "left").drop("_s")
        .withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, epochs, part, taken. The last document of a
    fractional pass may give only part of its words, so the taken words of a source equal its
    rounded target (less at most the ties at the cut). Null text, empty text: size 0, nothing taken.
    Null source: a source of its own, last in order. Null or repeated doc_id: each row counts; equal
    rows at the cut share evenly. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.struct("doc_id", "source", "text").alias("row"))
    base = materialize(keyed(rows, "row", seed).select("row.doc_id", "source", "size", "key"), "mix-base")
    return with_plan(base, mix_plan(base, weights, cap)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "epochs", "part")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix as documents: each row once per epoch, and once more if the fractional pass takes
    at least half of it; documents are never cut. Columns and values are those of ``docs``.
    """
    base = keyed(docs.select(F.struct(*docs.columns).alias("row")), "row", seed)
    plan = mix_plan(materialize(base.drop("row"), "mix-base"), weights, cap)
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return (
        with_plan(base, plan).withColumn("_n", copies.cast("int")).filter("_n > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("row.*")
    )


SQL = f"""
WITH base AS (
  SELECT doc_id, source, length(text) AS chars, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(length(text)::VARCHAR, '')), 1, 13))::BIGINT
      + 0.5::DOUBLE) / {2**52}::DOUBLE AS u
  FROM documents),
near AS (SELECT *, (chars::DOUBLE / size::DOUBLE - 7.0::DOUBLE) / 3.0::DOUBLE AS near FROM base),
keyed AS (
  SELECT doc_id, source, size, -ln(u) / CASE WHEN size > 0 THEN 0.5::DOUBLE + 0.5::DOUBLE / (1.0::DOUBLE + near * near)
    ELSE 0.5::DOUBLE END AS key FROM near),
sizes AS (SELECT source, sum(size)::DOUBLE AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, source_size, {CAP} * source_size AS cap, sum(source_size) OVER () AS total,
    [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
  FROM sizes),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, least(cap, coalesce(max(level) OVER (), 0) * w) AS target FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.source, k.size, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key) AS upto,
    sum(k.size) OVER (PARTITION BY k.source, k.key) AS tied, count(*) OVER (PARTITION BY k.source, k.key) AS ties
  FROM keyed k JOIN plans p ON k.source IS NOT DISTINCT FROM p.source),
parts AS (
  SELECT *, (CASE WHEN upto <= rest THEN size WHEN upto - tied >= rest THEN 0
    ELSE least(size, floor((rest - upto + tied) / ties)) END)::BIGINT AS part FROM placed)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (epochs * size + part)::BIGINT AS taken,
  source, epochs, part FROM parts
"""
