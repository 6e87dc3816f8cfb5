"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash and never changes. Bytes per slot are aggregated, and a map from slots
to shards is laid out so that the shards' bytes are near equal. The map is stored as one version
among others; rebalancing edits it (few slots move) instead of hashing records anew.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path, materialize
from .common import bounded_rows

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16
MAP = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                    T.StructField("first", T.LongType())])


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row. A null text has no bytes and crc 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(text).cast("string")))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        (F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % slots).cast("int").alias("virtual_slot"),
    )


def slot_totals(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot; at most ``slots`` entries, a parameter."""
    rows = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in rows}


def lay_out(totals: dict[int, tuple[int, int]], shards: int = SHARDS) -> dict[int, int]:
    """Slots to shards, the largest slot first, each to the lightest shard so far."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(totals, key=lambda s: (-totals[s][0], s)):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + totals[slot][0], shard))
    return out


def rebalance(slot_map: dict[int, int], totals: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """An edited copy of the map for changed bytes or more shards.

    Slots leave the heaviest shard for the lightest, each move the largest slot that narrows the
    gap, until no shard is more than ``tolerance`` above the mean or no move helps.
    """
    out = dict(slot_map)
    loads = {s: 0 for s in range(shards)}
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in out.items():
        size = totals.get(slot, (0, 0))[0]
        loads[shard] += size
        held[shard].append((size, slot))
    mean = sum(loads.values()) / shards
    while True:
        high, low = max(loads, key=lambda s: (loads[s], -s)), min(loads, key=lambda s: (loads[s], s))
        movable = [x for x in held[high] if 0 < x[0] < loads[high] - loads[low]]
        if loads[high] <= mean * (1 + tolerance) or not movable:
            return out
        size, slot = move = max(movable, key=lambda x: (x[0] <= (loads[high] - loads[low]) / 2, x[0] if x[0] <= (loads[high] - loads[low]) / 2 else -x[0], -x[1]))
        held[high].remove(move)
        held[low].append(move)
        loads[high] -= size
        loads[low] += size
        out[slot] = low


def store_map(spark: SparkSession, slot_map: dict[int, int], totals: dict[int, tuple[int, int]], folder: str, version: int) -> DataFrame:
    """Writes one version of the map, with the first place of each slot inside its shard."""
    first: dict[int, int] = {}
    entries = []
    for slot in sorted(slot_map):
        shard = slot_map[slot]
        entries.append({"virtual_slot": slot, "shard": shard, "first": first.get(shard, 0)})
        first[shard] = first.get(shard, 0) + totals.get(slot, (0, 0))[1]
    path = f"{folder}/version={version}"
    bounded_rows(spark, json.dumps(entries), MAP).coalesce(1).write.parquet(path)
    return spark.read.schema(MAP).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Puts every row into a shard under the law ``bytes``: shards of near equal size.

    Returns doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, from 0 without
    gaps), grown_shard (null under this law), virtual_slot, map_version. Null doc_id or text: hashed as
    empty. Rows equal in doc_id and text share a virtual slot, which is never split. Empty table: no rows.
    """
    spark = docs.sparkSession
    placed = materialize(records(docs, slots), "shard-records")
    totals = slot_totals(placed)
    slot_map = store_map(spark, lay_out(totals, shards), totals, folder or fresh_path(spark, "slot-map"), 1)
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_place", F.row_number().over(order) - 1)
        .join(F.broadcast(slot_map), "virtual_slot")  # one row per slot: at most ``slots`` rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("first") + F.col("_place")).cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"))
    )
