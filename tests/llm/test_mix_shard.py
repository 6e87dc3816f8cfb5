import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import DOCS, documents, odd

from warywire.llm import mix, shard
from warywire.llm.common import table


def reshared(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    while over := {s for s in names if s not in full and target[s] > cap * sizes[s] + 1e-9}:
        full |= over
        rest = total - sum(cap * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / left for s in names}
    return target


def check_mix(rows):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    target = reshared(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
    return {s: taken[s] - target[s] for s in sizes}


def test_targets_and_taken_words(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mix.mix(docs).collect()
    assert max(abs(d) for d in check_mix(rows).values()) <= 0.5
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == words
    again = mix.mix(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_caps_are_reshared_in_turn(spark):
    docs = documents(spark, (1, "a " * 2, "a"), (2, "b " * 30, "b"), (3, "c " * 3, "c"), (4, "d " * 500, "d"), (5, "e", None))
    off = check_mix(mix.mix(docs).collect())
    assert max(abs(d) for d in off.values()) <= 0.5


def test_nulls_blanks_and_repeats(spark):
    docs = documents(spark, (None, "a b c"), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "a b c d", None), (4, "a b c d", None))
    rows = mix.mix(odd(docs)).collect()
    assert len(rows) == 7 and sorted(r["size"] for r in rows) == [0, 0, 0, 3, 3, 4, 4]
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert max(abs(d) for d in check_mix(rows).values()) <= 2  # equal rows at the cut share evenly


def test_empty_and_wordless_tables(spark):
    assert mix.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in mix.mix(documents(spark, (1, "", "a"), (2, None, "b"))).collect()] == [0, 0]


def test_better_documents_are_preferred(spark):
    docs = documents(spark, *[(i, ("x" if i % 2 else "natural") + " words here", "a") for i in range(400)], *[(400 + i, "w " * 9, "b") for i in range(2)])
    keyed = mix.keyed(docs.selectExpr("struct(*) row"), "row", 1).selectExpr("row.doc_id % 2 good", "key").collect()
    mean = lambda v: sum(k.key for k in keyed if k.good == v) / sum(k.good == v for k in keyed)
    assert mean(0) < mean(1) * 1.2


def test_mixed_documents_repeat_whole_rows(spark, sf):
    docs = table(spark, sf, "documents")
    copies = Counter(r.doc_id for r in mix.mixed_documents(odd(docs)).collect())
    plan = {r.doc_id: r for r in mix.mix(docs).collect()}
    for i, r in plan.items():
        assert copies[i] == r.epochs + (r.part > 0 and 2 * r.part >= r["size"])
    assert mix.mixed_documents(docs).columns == docs.columns


def laid_out(docs, slots, shards):
    """Shards by brute force."""
    slot_of, size_of = {}, {}
    for d in docs:
        text = (d.text or "").encode()
        name = f"{'' if d.doc_id is None else d.doc_id}|{zlib.crc32(text)}"
        slot_of[d.doc_id] = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % slots
        size_of[d.doc_id] = len(text) + 16
    weight = Counter()
    for i, s in slot_of.items():
        weight[s] += size_of[i]
    loads, out = [(0, s) for s in range(shards)], {}
    for slot in sorted(weight, key=lambda s: (-weight[s], s)):
        load, where = heapq.heappop(loads)
        out[slot] = where
        heapq.heappush(loads, (load + weight[slot], where))
    return {i: out[s] for i, s in slot_of.items()}, size_of


def test_shards_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = shard.shard(docs).collect()
    where, sizes = laid_out(docs.collect(), shard.SLOTS, shard.SHARDS)
    assert {r.doc_id: r.shard for r in rows} == where
    assert {r.doc_id: r["size"] for r in rows} == sizes
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_shard_bytes_are_near_equal(spark):
    docs = documents(spark, *[(i, "word " * (i % 50)) for i in range(4000)])
    loads = Counter()
    for r in shard.shard(docs, shards=8).collect():
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.01 * max(loads.values())


def test_shard_edges(spark):
    assert shard.shard(spark.createDataFrame([], DOCS)).count() == 0
    rows = shard.shard(odd(documents(spark, (None, None), (None, None), (1, ""), (1, "")))).collect()
    assert [r["size"] for r in rows] == [16] * 4 and {r.text_crc32 for r in rows} == {0}
    assert len({(r.shard, r.slot) for r in rows}) == 4


def test_rebalancing_moves_few_slots():
    totals = {s: (100 + s % 7, 1) for s in range(1000)}
    first = shard.lay_out(totals, 10)
    grown = shard.rebalance(first, totals, 11)
    moved = [s for s in first if first[s] != grown[s]]
    loads = Counter()
    for s, where in grown.items():
        loads[where] += totals[s][0]
    assert max(loads.values()) <= 1.03 * sum(loads.values()) / 11
    assert all(grown[s] == 10 for s in moved) and len(moved) <= 1.2 * 1000 / 11


def test_map_versions_are_kept(spark, tmp_path):
    totals = {0: (10, 2), 1: (5, 1)}
    shard.store_map(spark, {0: 0, 1: 1}, totals, str(tmp_path), 1)
    shard.store_map(spark, {0: 0, 1: 0}, totals, str(tmp_path), 2)
    both = spark.read.parquet(str(tmp_path)).collect()
    assert {(r.version, r.virtual_slot, r.shard, r["first"]) for r in both} == {(1, 0, 0, 0), (1, 1, 1, 0), (2, 0, 0, 0), (2, 1, 0, 2)}
