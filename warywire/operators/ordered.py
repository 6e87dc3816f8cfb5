"""Ranks, running totals and order statistics that never sort a whole group in one task.

Both helpers work in two levels: count small buckets, turn the bucket counts into
offsets, then number the rows inside each bucket. Buckets are prefixes of a hash (for
pseudo-random orders) or ranges of the value (for real orders).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def hash_key(ident: Column, seed: object) -> Column:
    """A pseudo-random, engine-independent order key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def _key(by: Sequence[str], bucket: str) -> Column:
    """Group and bucket as one struct. A struct is never null and nulls inside it compare
    equal, so the window and the join below share one partitioning also for null groups."""
    return F.struct(*by, bucket)


def _offsets(counts: DataFrame, by: Sequence[str], bucket: str, sums: Sequence[str]) -> DataFrame:
    """Per (by, bucket): the totals before it (``before_x``) and of the whole group (``total_x``)."""
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return counts.select(
        _key(by, bucket).alias("_k"), F.col(bucket).alias("_last"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums],
    )


def hash_rank(df: DataFrame, by: Sequence[str], ident: str, seed: object = 42,
              rank: str = "rank", total: str = "group_rows", digits: int = 4) -> DataFrame:
    """Adds the 1-based rank of each row within ``by`` in pseudo-random order, and the group size.

    A group of any size is spread over 16**digits hash buckets, so a label that holds
    most of the table is still ranked by many tasks. The offsets are joined on the same
    keys as the window, so the rows are shuffled once.
    """
    keyed = df.withColumn("_h", hash_key(F.col(ident), seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("n"))
    offsets = _offsets(counts, by, "_b", ["n"])
    within = Window.partitionBy("_k").orderBy("_h", ident)
    ranked = keyed.withColumn("_k", _key(by, "_b")).withColumn("_r", F.row_number().over(within))
    return ranked.join(offsets, "_k").select(
        *df.columns,
        (F.col("before_n") + F.col("_r")).alias(rank),
        F.col("total_n").alias(total),
    )


def sample_n(df: DataFrame, n: int = 5000, ident: str = "message_id", seed: object = 42, digits: int = 4) -> DataFrame:
    """At most n rows without replacement: the n smallest hash keys.

    The key prefix that holds the n-th row is found from bucket counts first, so the final
    sort sees about n rows and not n rows from every partition.
    """
    keyed = df.withColumn("_h", hash_key(F.col(ident), seed))
    counts = keyed.groupBy(F.substring("_h", 1, digits).alias("_b")).agg(F.count("*").alias("n"))
    last = _offsets(counts, [], "_b", ["n"]).filter(F.col("before_n") < n).agg(F.max("_last")).first()[0]
    if last is None:
        return df
    near = keyed.filter(F.substring("_h", 1, digits) <= last)
    return near.orderBy("_h", ident).limit(n).drop("_h")


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition by ``order`` and pin the partition number in a written table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str],
                   by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds ``cum_x`` (inclusive running sum) and ``total_x`` for each summed column.

    Rows must be distinct in (by, order); collapse ties with a groupBy first, which also
    removes hot values before the range partitioning.
    """
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    pinned = ranged(df, [F.col(c) for c in by] + keys)
    totals = pinned.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = _offsets(totals, by, "_part", sums)
    if not by:  # at most one row per shuffle partition
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("_k").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = pinned.withColumn("_k", _key(by, "_part")).withColumns({f"cum_{c}": F.sum(c).over(within) for c in sums})
    return summed.join(offsets, "_k").select(
        *df.columns,
        *[(F.col(f"cum_{c}") + F.col(f"before_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def quantiles(df: DataFrame, col: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Values are collapsed to counts and ranked by running totals, so no task holds all
    values of a group.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, [col], ["n"], by)
    aggs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("total_n") - 1)
        low = F.min(F.when(F.col("cum_n") > F.floor(place), F.col(col)))
        high = F.min(F.when(F.col("cum_n") > F.ceil(place), F.col(col)))
        part = F.max(place - F.floor(place))
        aggs.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*aggs)


def running_count(df: DataFrame, by: Sequence[str], order: str, bucket: Column, ident: str,
                  out: str = "running_count") -> DataFrame:
    """Running number of rows per group in time order.

    ``bucket`` must not decrease along ``order`` (say, the hour of a timestamp); it splits
    a busy group over many tasks.
    """
    keyed = df.withColumn("_b", bucket)
    offsets = _offsets(keyed.groupBy(*by, "_b").agg(F.count("*").alias("n")), by, "_b", ["n"])
    within = Window.partitionBy("_k").orderBy(order, ident)
    ranked = keyed.withColumn("_k", _key(by, "_b")).withColumn("_r", F.row_number().over(within))
    return ranked.join(offsets, "_k").select(*df.columns, (F.col("before_n") + F.col("_r")).alias(out))


def last_n(df: DataFrame, n: int = 6, order: Sequence[str] = ("ts", "message_id")) -> DataFrame:
    """The n most recent rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
