"""SimHash near-duplicates with a hierarchical index over fingerprints in Gray order.

Equal fingerprints are collapsed first. Each distinct fingerprint is then filed under some masked bit
patterns (a mask and the fingerprint's bits under it), the upper nodes of the index: two fingerprints
within the radius share at least one pattern. Under a pattern the fingerprints are sorted by Gray rank,
so neighbours share further bits; runs of them form nodes that hold the bits all members agree on, and
a search drops a whole node as soon as the differences accumulated on those bits exceed the radius.

A pattern shared by many fingerprints (near copies of one text) is refined by longer masks, level by
level, until groups are small or their free bits bound them. A group emits links to one
representative per local component, never all its pairs; components join them over the groups.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast, discard, materialize
from .common import bounded_rows
from .components import components
from .jaccard import Hasher, enough, possible, signature, verified

SEED = 42
BITS = 64
RADIUS = 2
SHINGLE = 3
GROUP = 1024
LEAF = 32
PAIRS = 250_000  # compared at a time; with four words each, some 30 MB
FINER = T.StructType([T.StructField("above", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("mask", T.LongType())])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included. Fewer words: of the whole sequence; none: empty."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the blanks 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    tails = [words[i:] for i in range(shingle)]
    return np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*tails))), np.uint64, len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; no hashes: zero."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in pieces
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big") if len(hashes) else 0


MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def remixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """An independent hash of the same shingles for a further word of a long fingerprint; word 0 is the hash itself."""
    if word == 0:
        return hashes
    with np.errstate(over="ignore"):
        out = hashes * np.uint64(MIX[(word - 1) % len(MIX)]) + np.uint64(word)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", shingle: int = SHINGLE,
                 words: int = 1) -> DataFrame:
    """``keep`` and ``fp``, array<long> of ``words`` 64-bit fingerprint words, for every whole text."""
    keep = list(keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fp", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for value in batch.column(len(keep)):
                hashes = shingle_hashes(value.as_py() or b"", shingle)
                found.append([signed(fingerprint(remixed(hashes, w))) for w in range(words)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: the prefix parity of its bits."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def linked(codes: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], radius: int) -> np.ndarray:
    """The local component (place of a representative) of each of the codes of one group.

    ``codes`` are in Gray order; ``near(i, j)`` confirms pairs of places. Levels of nodes of ``LEAF``
    members hold the bits on which all members agree; a query descends only into nodes from which it
    differs in at most ``radius`` of those bits.
    """
    root = np.arange(len(codes))
    for q, node in near_pairs(codes, radius):
        kept = near(q, node)
        join(root, q[kept], node[kept])
    return settle(root)


def near_pairs(codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (the smaller first) of Gray-ordered codes that differ in at most ``radius`` bits, in parts."""
    n = len(codes)
    levels = []
    low, high = codes, codes  # bits set in all members, bits set in any member
    while len(low) > LEAF:
        cuts = np.arange(0, len(low), LEAF)
        low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
        levels.append((low, ~(low ^ high)))
    step = min(2048, max(16, PAIRS // n))
    for at in range(0, n, step):
        queries = np.arange(at, min(n, at + step))
        width = len(levels[-1][0]) if levels else n
        q, node = np.repeat(queries, width), np.tile(np.arange(width), len(queries))
        for depth in range(len(levels) - 1, -1, -1):
            value, mask = levels[depth]
            kept = np.bitwise_count((codes[q] ^ value[node]) & mask[node]) <= radius
            q, node = q[kept], node[kept]
            below = len(levels[depth - 1][0]) if depth else n
            q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            kept = (node < below) & (node >= 0)
            q, node = q[kept], node[kept]
        kept = (node > q) & (np.bitwise_count(codes[q] ^ codes[node]) <= radius)
        yield q[kept], node[kept]


def settle(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the components of the pairs, in place: roots take the smallest place they meet."""
    while len(a):
        root[:] = settle(root)
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def blocks(free: int, count: int) -> list[int]:
    """The set bits of ``free`` dealt into ``count`` masks of consecutive bits."""
    bits = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, dtype=object), count)]


def pigeonhole(radius: int) -> Callable[[int], list[int]]:
    """Longer masks below a mask: its free bits in radius + 1 blocks, of which two fingerprints within
    the radius agree on at least one. Exact at every level; fewer free bits than blocks are not divided."""
    def below(mask: int) -> list[int]:
        free = ~mask & (2**BITS - 1)
        return [mask | b for b in blocks(free, radius + 1)] if free.bit_count() > radius else []

    return below


def group_links(fps: DataFrame, masks: Callable[[int], list[int]], radius: int, verify: int | None = None, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints: per group of equal masked bits, each member and its
    local component's representative.

    ``fps`` has ``id`` (long, unique) and ``fp``. Two fingerprints are linked if their first words differ
    in at most ``radius`` bits and, with ``verify``, all words together in at most that many. Groups above
    ``group`` members go on to longer masks until there are none.
    """
    level = masks(0)
    filed = _file(fps.withColumn("w", F.col("fp")[0]), level)
    out = []
    while True:
        filed = materialize(filed, "simhash-groups")
        counts = filed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        finer = [(t, below) for t, m in enumerate(level) for below in masks(m)]
        finer = [(above, t, mask) for t, (above, mask) in enumerate(finer)]
        deep = sorted({above for above, _, _ in finer})
        large = (F.col("n") > group) & F.col("t").isin(deep)
        out.append(_local(filed.join(counts.filter(~large).select("t", "key"), ["t", "key"]), radius, verify))
        big = materialize(counts.filter(large).select("t", "key"), "simhash-large")
        if not deep or not big.limit(1).count():
            break
        filed = _refile(filed.join(big, ["t", "key"]).select("t", "id", "fp"), finer)
        level = [mask for _, _, mask in finer]
    links = out[0]
    for more_links in out[1:]:
        links = links.unionAll(more_links)
    return links


def _file(words: DataFrame, masks: list[int]) -> DataFrame:
    """(t, key, id, fp): every fingerprint under each of the first masks."""
    entry = F.array(*[F.struct(F.lit(t).alias("t"), F.col("w").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    return words.select(F.explode(entry).alias("e"), "id", "fp").select("e.t", "e.key", "id", "fp")


def _refile(hot: DataFrame, finer: list[tuple[int, int, int]]) -> DataFrame:
    """The same under the longer masks (mask above, number, mask); their number is set by the parameters."""
    rows = bounded_rows(hot.sparkSession, json.dumps([{"above": a, "t": t, "mask": signed(m)} for a, t, m in finer]), FINER)
    return hot.withColumnRenamed("t", "above").join(F.broadcast(rows), "above").select(
        "t", F.col("fp")[0].bitwiseAND(F.col("mask")).alias("key"), "id", "fp")


def _local(groups: DataFrame, radius: int, verify: int | None) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        held: list = []
        for batch in batches:
            held.append(batch)
            last = held[-1]
            if not last.num_rows:
                held.pop()
                continue
            # groups come one after another; what precedes the last group of the batch is complete
            table = pa.Table.from_batches(held)
            t, key = table.column("t").to_numpy(), table.column("key").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])[-1])
            if cut:
                yield links_of(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield links_of(pa.Table.from_batches(held))

    def links_of(table):
        import pyarrow as pa

        t, key, ids = (table.column(c).to_numpy() for c in ("t", "key", "id"))
        flat = table.column("fp").combine_chunks()
        fp = flat.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        edges = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]), True])
        root = np.arange(len(ids))
        sizes = np.diff(edges)
        for start, size in zip(edges[:-1][sizes > 64], sizes[sizes > 64]):
            rows = start + np.argsort(gray_rank(fp[start:start + size, 0]), kind="stable")
            codes = fp[rows]
            found = linked(codes[:, 0].copy(), lambda i, j: close(codes[i], codes[j], radius, verify), radius)
            root[rows] = rows[found]
        small = np.flatnonzero(sizes <= 64)
        for size in np.unique(sizes[small]):  # short runs of one size are compared together
            a, b = np.triu_indices(size, 1)
            if not len(a):
                continue
            starts = edges[:-1][sizes == size]
            step = max(1, PAIRS // len(a))
            for at in range(0, len(starts), step):
                i = (starts[at:at + step, None] + a).ravel()
                j = (starts[at:at + step, None] + b).ravel()
                kept = close(fp[i], fp[j], radius, verify)
                join(root, i[kept], j[kept])
        root = settle(root)
        other = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[root[other]])], names=["a", "b"])

    width = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(width, "t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long")


def close(x: np.ndarray, y: np.ndarray, radius: int, verify: int | None) -> np.ndarray:
    apart = np.bitwise_count(x ^ y)
    kept = apart[:, 0] <= radius
    return kept if verify is None else kept & (apart.sum(axis=1, dtype=np.int64) <= verify)


def classes(rows: DataFrame, masks: Callable[[int], list[int]], radius: int, verify: int | None = None,
            group: int = GROUP) -> DataFrame:
    """Adds ``class`` (the smallest ``id`` reachable over links, null if all are) to rows of (id, fp, ...).
    Links join distinct fingerprints under numbers of their own, so one whose rows have no id links too."""
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id())
    distinct = materialize(distinct, "simhash-distinct")
    found = components(group_links(distinct.select("id", "fp"), masks, radius, verify, group))
    named = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("fp").alias("_fp"), "least", F.coalesce("root", "id").alias("root"))
    named = materialize(named, "simhash-named")
    smallest = named.groupBy("root").agg(F.min("least").alias("class"))
    return rows.join(named.join(smallest, "root").select("_fp", "class"), F.col("fp") == F.col("_fp"), "left").drop("_fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its fingerprint and component.

    Returns doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links
    of at most ``radius`` differing bits, itself included). Null, empty or blank text: fingerprint zero,
    linked like any other. Repeated rows: each is returned. Null doc_id: returned with its own component
    computed from the other rows of equal or near fingerprints, null if there are none. Empty table: no
    rows. Other columns are not read.
    """
    marked = fingerprints(docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")), ["id"], "text", shingle)
    marked = materialize(marked, "simhash-fingerprints")
    found = classes(marked, pigeonhole(radius), radius)
    return found.select(F.col("id").alias(ident), F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"),
                        F.col("class").alias("component_id"))


WORDS = 4
PIPELINE_SHINGLE = 5
PERCENT = 80
MISS = 0.03
DEVIATIONS = 4
NEAREST = 4
PART = 2048
HELD = 1 << 24  # bytes of text of a part whose sets are compared; a set's hashes take about as many


def apart(similarity: float) -> float:
    """The chance that a fingerprint bit differs between shingle sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_for(similarity: float, bits: int, deviations: float = DEVIATIONS) -> int:
    """How many of ``bits`` fingerprint bits may differ: the expected number and some standard deviations."""
    q = apart(similarity)
    return math.ceil(q * bits + deviations * math.sqrt(bits * q * (1 - q)))


def tables_for(bits: int, similarity: float, miss: float = MISS, words: int = WORDS) -> int:
    """How many random masks of ``bits`` bits, dealt over ``words`` words, miss a pair of that similarity with a chance of ``miss`` at most."""
    q = apart(similarity)
    each = [(math.comb(BITS, d) * q**d * (1 - q) ** (BITS - d), math.comb(BITS - d, bits) / math.comb(BITS, bits)) for d in range(BITS - bits + 1)]
    rest = 1 - sum(p for p, _ in each)
    m = 1
    while (rest + sum(p * (1 - hit) ** m for p, hit in each)) ** words > miss:
        m += 1
    return m * words


def masks_for(rows: int, similarity: float, seed: int = 5) -> list[tuple[int, int]]:
    """(word, mask) for a table of that many fingerprints: the masks grow with its logarithm, so that a pattern has
    few members by chance, and their number follows from the chance of a miss."""
    bits = min(40, max(4, math.ceil(math.log2(max(2, rows))) - 2))
    draw = np.random.default_rng([seed, bits])
    return [(t % WORDS, sum(1 << int(b) for b in draw.choice(BITS, bits, replace=False))) for t in range(tables_for(bits, similarity))]


def _patterns(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(t, key, ...): every row under each of the masks."""
    entry = F.array(*[F.struct(F.lit(t).alias("t"), F.get("fp", F.lit(w)).bitwiseAND(F.lit(signed(m))).alias("key")) for t, (w, m) in enumerate(masks)])
    return fps.select(F.explode(entry).alias("e"), *fps.columns).select("e.t", "e.key", *fps.columns)


def candidates(fps: DataFrame, similarity: float, part: int = PART, nearest: int = NEAREST) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ids of (id, fp) that may be that similar, and the patterns (t, key) under which there may be more.

    Under each masked pattern the members meet. Where one has more than ``nearest`` partners, only a tree of the nearest pairs is returned,
    which is as long as the pattern has members and ties what all its pairs tie at any number of differing bits. A pattern with more
    than ``part`` members is dealt into parts, by another hash under every mask. Patterns that were dealt, or of which a tree was taken, are
    returned for ``further``.
    """
    masks = masks_for(fps.count(), similarity)
    radius, verify = bits_for(similarity, BITS), bits_for(similarity, BITS * WORDS)
    filed = _patterns(fps.select("id", "fp"), masks)
    hot = filed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > part).select("t", "key", F.ceil(F.col("n") / part).cast("long").alias("parts"))
    hot = bounded_broadcast(materialize(hot, "simhash-hot"), 500_000)  # a pattern for each ``part`` rows and mask at most
    dealt = filed.join(hot, ["t", "key"], "left").select(
        "t", "key", F.coalesce(F.pmod(F.xxhash64("id", "t"), F.col("parts")), F.lit(0)).cast("int").alias("part"), "id", "fp")

    def run(batches):
        import pyarrow as pa

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(edges_of(table))[-1])
            if cut:
                yield pairs_of(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    def edges_of(table):
        t, key, at = (table.column(c).to_numpy() for c in ("t", "key", "part"))
        return np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])]

    def pairs_of(table):
        import pyarrow as pa

        ids, t, key = (table.column(c).to_numpy() for c in ("id", "t", "key"))
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        edges = np.flatnonzero(np.r_[edges_of(table), True])
        sizes = np.diff(edges)
        found = [np.zeros((2, 0), np.int64)]
        cut = [np.zeros(0, np.int64)]  # places of members whose partners were cut

        def near(i, j):
            kept = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= verify
            found.append(np.stack([i[kept], j[kept]]))

        for start, size in zip(edges[:-1][sizes > 64], sizes[sizes > 64]):
            word = fp[start:start + size, masks[t[start]][0]]
            rows = start + np.argsort(gray_rank(word), kind="stable")
            own = len(found)
            for q, node in near_pairs(fp[rows, masks[t[start]][0]].copy(), radius):
                near(rows[q], rows[node])
            if len(found) > own:
                every = np.concatenate(found[own:], axis=1)
                over = crowded(every, nearest)
                found[own:] = [tree(every, fp) if len(over) else every]
                cut.append(over)
        large, found = found, [np.zeros((2, 0), np.int64)]
        small = np.flatnonzero(sizes <= 64)
        for size in np.unique(sizes[small]):  # short runs of one size are compared together
            a, b = np.triu_indices(size, 1)
            if not len(a):
                continue
            starts = edges[:-1][sizes == size]
            step = max(1, PAIRS // len(a))
            for at in range(0, len(starts), step):
                near((starts[at:at + step, None] + a).ravel(), (starts[at:at + step, None] + b).ravel())
        every = np.concatenate(found, axis=1)
        cut.append(crowded(every, nearest))
        # a row is a pair, or (t, key, null) of a pattern that was cut
        more = np.unique(np.searchsorted(edges, np.concatenate(cut), "right") - 1)
        over = np.isin(np.searchsorted(edges, every[0], "right") - 1, more)
        best = np.concatenate([*large, every[:, ~over], tree(every[:, over], fp)], axis=1)
        x, y = ids[best[0]], ids[best[1]]
        none = pa.nulls(len(x), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([none, pa.array(t[edges[more]], pa.int32())]), pa.array(np.r_[np.maximum(x, y), key[edges[more]]]),
            pa.concat_arrays([pa.array(np.minimum(x, y)), pa.nulls(len(more), pa.int64())])], names=["t", "a", "b"])

    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = dealt.repartition(width, "t", "key", "part").sortWithinPartitions("t", "key", "part")
    met = materialize(sorted_rows.mapInArrow(run, "t int, a long, b long").distinct(), "simhash-met")
    cuts = met.filter("t is not null").select("t", F.col("a").alias("key")).unionAll(hot.select("t", "key")).distinct()
    return met.filter("t is null").select("a", "b"), materialize(cuts, "simhash-cuts")


def crowded(pairs: np.ndarray, nearest: int) -> np.ndarray:
    """The places with more than ``nearest`` partners."""
    return np.flatnonzero(np.bincount(pairs.ravel()) > nearest)


def tree(pairs: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """A forest of the pairs of places that ties all they tie, of the least differing bits (ties to the earlier pair)."""
    if not pairs.shape[1]:
        return pairs
    key = np.concatenate([np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) << 40 for x, y in (
        pairs[:, at:at + PAIRS] for at in range(0, pairs.shape[1], PAIRS))]) | np.arange(pairs.shape[1])
    root, taken, left = np.arange(int(pairs.max()) + 1), [], key
    while True:  # every component takes its least pair to another one
        places = left & (1 << 40) - 1
        x, y = root[pairs[0, places]], root[pairs[1, places]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return pairs[:, np.concatenate(taken)]
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        took = np.unique(least[least < np.iinfo(np.int64).max]) & (1 << 40) - 1
        taken.append(took)
        join(root, pairs[0, took], pairs[1, took])
        root = settle(root)


def further(fps: DataFrame, cuts: DataFrame, similarity: float, part: int = PART, sets: Callable[[DataFrame], DataFrame] | None = None,
            percent: int = PERCENT) -> DataFrame:
    """All pairs (a, b) of (id, fp, root) that may be that similar and meet under one of the patterns ``cuts``, of different roots.

    Under a pattern the members of its most frequent root need not meet each other. These and the others are dealt into parts of about
    ``part``; a part of the others meets all parts, so memory is bounded and a large group of copies is met only by what is outside it.
    With ``sets``, which gives the shingle sets of ids, and ``size`` in ``fps`` (bytes of text, about ``HELD`` in a part at most) the pairs are
    confirmed by ``percent`` where they meet, and returned are links that tie all which the confirmed ones tie: no more than members.
    """
    masks = masks_for(fps.count(), similarity)
    radius, verify = bits_for(similarity, BITS), bits_for(similarity, BITS * WORDS)
    few = bounded_broadcast(cuts, 500_000)
    size = F.lit(0) if sets is None else F.col("size")
    filed = _patterns(fps.select("id", "fp", "root", size.cast("long").alias("size")), masks).join(few, ["t", "key"], "left_semi")
    filed = materialize(filed, "simhash-cut-patterns")
    counts = filed.groupBy("t", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    tops = counts.groupBy("t", "key").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"),
                                          F.count("*").alias("roots")).filter("roots > 1")

    def parts(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / part, size / HELD)).cast("int")

    tops = materialize(tops.select("t", "key", F.col("top.root").alias("top"), parts(F.col("top.n"), F.col("top.size")).alias("tops"),
                                   parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("others")), "simhash-open")
    joined = filed.join(tops, ["t", "key"])
    if sets is not None:
        joined = materialize(joined, "simhash-met-again")
        joined = joined.join(materialize(sets(joined.select("id").distinct()), "simhash-sets").withColumnRenamed("sid", "id"), "id")
    # groups (i, j): part i of the others with part j of the others (j >= i) or, numbered from ``others`` on, of the top root
    hashed = F.xxhash64("id", "t", F.lit(3))
    other = F.col("root") != F.col("top")
    own = F.when(other, F.pmod(hashed, F.col("others"))).otherwise(F.col("others") + F.pmod(hashed, F.col("tops"))).cast("int")
    joined = joined.withColumn("own", own)
    groups = F.when(F.col("root") != F.col("top"), F.transform(F.sequence(F.lit(0), F.col("others") + F.col("tops") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))).otherwise(F.transform(
            F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    of_set = [] if sets is None else ["n", "signature", "hashes"]
    dealt = joined.select("t", "key", "own", "id", "fp", "root", *of_set, F.inline(groups)).withColumn("g", F.xxhash64("t", "key", "i", "j"))

    def run(batches):
        import pyarrow as pa

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            cut = int(edges_of(table)[-2])
            if cut:
                yield from pairs_of(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    def edges_of(table):
        g, t, key, i, j = (table.column(c).to_numpy() for c in ("g", "t", "key", "i", "j"))
        apart = np.zeros(max(0, len(g) - 1), bool)
        for c in (g, t, key, i, j):
            apart |= c[1:] != c[:-1]
        return np.flatnonzero(np.r_[True, apart, True])

    def pairs_of(table):
        import pyarrow as pa

        ids, t, i, own, root = (table.column(c).to_numpy() for c in ("id", "t", "i", "own", "root"))
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        edges = edges_of(table)
        for start, end in zip(edges[:-1], edges[1:]):
            left = start + np.flatnonzero(own[start:end] == i[start])
            right = left if (own[start:end] == i[start]).all() else start + np.flatnonzero(own[start:end] != i[start])
            word = fp[:, masks[t[start]][0]]
            confirm = None if not of_set else ties(root[start:end], *(table.column(c).slice(start, end - start) for c in of_set), percent)
            for at in range(0, len(left), max(1, PAIRS // max(1, len(right)))):
                rows = left[at:at + max(1, PAIRS // max(1, len(right)))]
                x, y = np.nonzero((np.bitwise_count(word[rows][:, None] ^ word[right]) <= radius) & (root[rows][:, None] != root[right]))
                x, y = rows[x], right[y]
                kept = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= verify
                x, y = x[kept], y[kept]
                if confirm is not None:
                    kept = confirm(x - start, y - start)
                    x, y = x[kept], y[kept]
                x, y = ids[x], ids[y]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(width, "g").sortWithinPartitions("g", "t", "key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def ties(root: np.ndarray, n, signatures, hashes, percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For the members of one group (components and Arrow columns of their sets) a function that takes pairs of places and tells which of
    them are links. A pair between components that an earlier link has tied is none."""
    n, signatures, hashes = n.to_numpy(), signatures.to_pylist(), hashes.to_pylist()
    up = np.unique(root, return_inverse=True)[1]
    above = list(range(len(root)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    def confirm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(x), bool)
        for at in np.flatnonzero(100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])):
            i, j = int(x[at]), int(y[at])
            a, b = top(int(up[i])), top(int(up[j]))
            if a != b and possible(int(n[i]), int(n[j]), signatures[i], signatures[j], percent):
                own, other = np.frombuffer(hashes[i], np.uint64), np.frombuffer(hashes[j], np.uint64)
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                if enough(int((own[place] == other).sum()), int(n[i]), int(n[j]), percent):
                    kept[at] = True
                    above[max(a, b)] = min(a, b)
        return kept

    return confirm


def closest(pairs: np.ndarray, fp: np.ndarray, nearest: int) -> np.ndarray:
    """Of pairs of places, those where one is among the other's ``nearest`` by differing bits (ties to the smaller place), once each."""
    keys = [np.zeros(0, np.int64)]  # place, differing bits (256 at most) and the other's place in one number
    for at in range(0, pairs.shape[1], PAIRS):
        x, y = pairs[:, at:at + PAIRS]
        far = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) << 27
        keys += [x << 36 | far | y, y << 36 | far | x]
    key = np.concatenate(keys)
    del keys
    key.sort()
    own = key >> 36
    key = key[np.r_[np.ones(min(nearest, len(key)), bool), own[nearest:] != own[:-nearest]]]
    x, y = key >> 36, key & (1 << 27) - 1
    low = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y))
    return np.stack([low >> 32, low & (1 << 32) - 1])


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(sid, n, signature, hashes): the exact shingle sets of (id, text), as the confirmation takes them."""
    def run(batches):
        import pyarrow as pa

        hasher = Hasher(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [hasher.sets(t.as_py()) for t in batch.column(1).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, 500), pa.array([len(f) for f in found], pa.int32()),
                    pa.array([signature(f) if len(f) else b"" for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())],
                    names=["sid", "n", "signature", "hashes"])

    return rows.select("id", F.col("text").cast("binary")).mapInArrow(run, "sid long, n int, signature binary, hashes binary")


def one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = PIPELINE_SHINGLE) -> DataFrame:
    """The documents with one of each near-duplicate group kept, columns and values unchanged.

    Candidates are found by fingerprints of 4 x 64 bits over five-word shingles (``candidates``), then confirmed: a link needs a Jaccard
    similarity of ``percent`` in a hundred of the exact shingle sets. Where members of a pattern have more partners than are met at first,
    all pairs of those that are not tied yet are confirmed where they meet (``further``). Equal fingerprints are one. Of each group the row with the smallest
    doc_id stays (nulls last; of repeated rows the first). Null, empty and blank texts are one group. Empty table: no rows.
    """
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("id")), "simhash-rows")
    texts = rows.select("id", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    sized = texts.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    marked = materialize(fingerprints(sized, ["id", "doc_id", "size"], "text", shingle, WORDS), "simhash-fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("least")).select("fp", "least.*"), "simhash-distinct")
    pairs, cuts = candidates(distinct, percent / 100)

    def sets_of(named: DataFrame) -> DataFrame:
        own = texts.join(bounded_broadcast(materialize(named, "simhash-named"), 500_000), "id", "left_semi")
        return shingle_sets(own, shingle).filter("n > 0")

    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    sets = materialize(sets_of(ends), "simhash-sets")
    links = materialize(verified(pairs, sets, percent), "simhash-links")
    discard(sets)  # the open patterns' sets, which may be as many, come after them
    found = components(links)
    if cuts.limit(1).count():  # partners that the nearest ones didn't tie already
        rooted = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "fp", F.coalesce("root", "id").alias("root"), "size")
        more = materialize(further(materialize(rooted, "simhash-rooted"), cuts, percent / 100, sets=sets_of, percent=percent), "simhash-further")
        if more.limit(1).count():
            found = components(links.unionAll(more))
    classes_ = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "id").alias("class"))
    first = marked.join(classes_, F.col("fp") == F.col("_fp")).groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first"))
    stay = first.select(F.col("first.id").alias("id"))
    return rows.join(stay, "id", "left_semi").select("row.*")
