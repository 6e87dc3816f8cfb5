"""Exact Jaccard self-join of documents on word shingles.

Texts become sets of 64-bit hashes of five-word shingles. Two sets of Jaccard similarity s or more share a hash
among the first (1 - s) of each in any common order, so:

1. Sets are read in blocks. A fixed range of the hash space is counted over the whole table (hashes of a
   block once, dealt by range); a set with more hashes of its own than that first part holds has no partner.
2. The texts of the others are read again as whole sets, and all their hashes are counted likewise. Each
   set keeps as anchors the shared hashes among its first ones, rarest first.
3. Sets with one anchor in common, of neighbouring size bands (a factor of 1/s), form tiles. A pair of a tile is
   a candidate if its bitmap signatures leave it possible: the set bits of their difference bound the overlap from above.
   Candidates are settled by intersecting the sorted arrays.

Equal sets are one. The members of a tile first meet only a few of them (pivots), in rounds, which ties groups of near copies together;
tiles that then still hold sets of different components are compared member by member, in parts of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast, discard, materialize
from .components import components

SHINGLE = 5
PERCENT = 80
COUNTED = 5 / 16  # of the hash space, in the first counting
BLOCK = 500_000
RANGE = 1_000_000
TILE = 256
PIVOTS = (1, 3)  # in the first round, and in the second
WORDS = 300_000


class Hasher:
    """64-bit hashes of shingles from hashes of words, each distinct word hashed once."""

    def __init__(self, shingle: int, limit: int = WORDS) -> None:
        self.shingle, self.limit = shingle, limit
        self.words: dict[bytes, int] = {}
        odd = np.random.default_rng(5).integers(0, 1 << 63, shingle + 1, np.uint64)
        self.factors = odd * np.uint64(2) + np.uint64(1)

    def _hash(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word, 1)
        if len(self.words) > self.limit:
            self.words.clear()
        self.words[word] = value
        return value

    def sets(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a whole text; of one with fewer words the hash of them all."""
        words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the blanks 0x20 and 0x09 to 0x0D
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        h = np.fromiter((known.get(w) or self._hash(w) for w in words), np.uint64, len(words))
        size = min(len(h), self.shingle)
        with np.errstate(over="ignore"):
            out = np.full(len(h) - size + 1, size, np.uint64) * self.factors[-1]
            for i in range(size):
                part = h[i:len(h) - size + 1 + i] * self.factors[i]
                out = (out ^ (part ^ (part >> np.uint64(32)))) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return np.unique(out)


def digest(values: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a sorted array, as two signed numbers."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(values.tobytes())
    low, high = value & (1 << 64) - 1, value >> 64
    return tuple(v - (1 << 64) if v >> 63 else v for v in (low, high))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first hashes of a set of n must hold one of every partner's."""
    return n - -(-percent * n // 100) + 1


def signature(values: np.ndarray) -> bytes:
    """A bitmap of four bits for each member, rounded up to a power of two: the bits that the hashes' low ends name."""
    bits = max(64, 1 << (4 * len(values) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[values & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """The signature as 64-bit words, halved until it has ``size`` bytes: a fold is the signature of fewer low bits."""
    out = np.frombuffer(data, "<u8")
    while out.nbytes > size:
        half = len(out) // 2
        out = out[:half] | out[half:]
    return out


def possible(n: int, m: int, a: bytes, b: bytes, percent: int) -> bool:
    """Whether the bit counts leave ``percent`` in a hundred possible: each differing bit is a member of one set only."""
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return enough(max(0, (n + m - apart)) // 2, n, m, percent)


def enough(shared: int, n: int, m: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


BLOCKS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.IntegerType())),
    T.StructField("d1", T.ArrayType(T.LongType())), T.StructField("d2", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.StringType())),
    T.StructField("held", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.BinaryType())])


def blocks(rows: DataFrame, shingle: int, share: float, block: int) -> DataFrame:
    """Blocks of (doc_id, text, key): sizes, digests and keys of the sets, and of each set the hashes below ``share`` of
    the hash space, in the order of the sets. A set that the block has already held keeps no hashes."""
    limit = min((1 << 64) - 1, int(share * 2**64))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        hasher = Hasher(shingle)
        first = (TaskContext.get().partitionId() + 1) << 24
        number = 0
        ids, n, d1, d2, keys, held, values, seen, total = [], [], [], [], [], [], [], set(), 0

        def flushed():
            return pa.RecordBatch.from_arrays([
                pa.array([first + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32())),
                pa.array([d1], pa.list_(pa.int64())), pa.array([d2], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.string())),
                pa.array([held], pa.list_(pa.int32())), pa.array([np.concatenate(values).tobytes()], pa.binary())], names=BLOCKS.names)

        for batch in batches:
            for ident, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = hasher.sets(text.as_py())
                low, high = digest(found) if len(found) else (0, 0)
                part = found[:np.searchsorted(found, np.uint64(limit), "right")]
                if (low, high) in seen:
                    part = part[:0]
                seen.add((low, high))
                for out, value in ((ids, ident), (n, len(found)), (d1, low), (d2, high), (keys, key), (held, len(part)), (values, part)):
                    out.append(value)
                total += len(part) + 16
                if total > block:
                    yield flushed()
                    number += 1
                    ids, n, d1, d2, keys, held, values, seen, total = [], [], [], [], [], [], [], set(), 0
        if ids:
            yield flushed()

    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "key").mapInArrow(run, BLOCKS)


def grades(stored: DataFrame, share: float, size: int) -> DataFrame:
    """(block, grades): for each distinct hash of a block, in rising order, one byte: 0 if only one set of all blocks has it,
    else the rounded-down binary logarithm of its count.

    Blocks deal their distinct hashes, with the number of their sets that have them, over ranges of the hash space, each of which one group counts; the
    number of ranges follows the number of hashes, and a hash has one entry for each block at most.
    """
    total = stored.agg(F.coalesce(F.sum(F.length("hashes") / 8), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(total / size))
    width = int(share * 2**32) // ranges + 1

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values, counts = np.unique(np.frombuffer(data.as_py(), np.uint64), return_counts=True)
                counts = np.minimum(counts, 1 << 15).astype(np.uint16)
                edges = np.searchsorted((values >> np.uint64(32)) // np.uint64(width), np.arange(ranges + 1, dtype=np.uint64))
                here = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([
                    pa.array(here), pa.array(np.full(len(here), block)), pa.array([values[edges[r]:edges[r + 1]].tobytes() for r in here], pa.binary()),
                    pa.array([counts[edges[r]:edges[r + 1]].tobytes() for r in here], pa.binary())], names=["r", "block", "hashes", "counts"])

    def count(batches):
        import pyarrow as pa

        held: list = []  # the rows of one range
        last = None

        def graded():
            values = np.concatenate([np.frombuffer(v, np.uint64) for _, v, _ in held])
            counts = np.concatenate([np.frombuffer(c, np.uint16) for _, _, c in held])
            _, back = np.unique(values, return_inverse=True)
            total = np.bincount(back, counts)[back]
            grade = np.floor(np.log2(total)).astype(np.uint8)
            ends = np.cumsum([len(v) // 8 for _, v, _ in held])
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _, _ in held]), pa.array([last] * len(held), pa.int64()),
                pa.array([g.tobytes() for g in np.split(grade, ends[:-1])], pa.binary())], names=["block", "r", "grade"])

        for batch in batches:
            for r, block, values, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if r != last and held:
                    yield graded()
                    held.clear()
                last = r
                held.append((block, values, counts))
        if held:
            yield graded()

    dealt = stored.select("block", "hashes").mapInArrow(deal, "r long, block long, hashes binary, counts binary")
    counted = dealt.repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(count, "block long, r long, grade binary")
    return counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("r", "grade"))).alias("graded"))


def _joined(stored: DataFrame, counted: DataFrame) -> DataFrame:
    return stored.join(counted, "block", "left")


def _grade_of(values: np.ndarray, graded: list | None) -> np.ndarray:
    """The grade of each hash of a block from the grades of its distinct hashes."""
    if not len(values):
        return np.zeros(0, np.uint8)
    whole = np.frombuffer(b"".join(g["grade"] for g in graded), np.uint8)
    return whole[np.unique(values, return_inverse=True)[1]]


def surviving(stored: DataFrame, share: float, size: int, percent: int) -> DataFrame:
    """(block, at): the sets that may have a partner."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, n, held, data, graded in zip(*[c.to_pylist() for c in batch.columns]):
                values = np.frombuffer(data, np.uint64)
                n, held = np.array(n, np.int64), np.array(held, np.int64)
                own = np.concatenate([[0], np.cumsum(_grade_of(values, graded) == 0)])
                ends = np.cumsum(held)
                single = own[ends] - own[ends - held]
                at = np.flatnonzero((n > 0) & (single < prefix(n, percent)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32))], names=["block", "at"])

    return _joined(stored, grades(stored, share, size)).select("block", "n", "held", "hashes", "graded").mapInArrow(run, "block long, at int")


SETS = T.StructType([
    T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("signature", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))])


def anchored(stored: DataFrame, size: int, percent: int) -> DataFrame:
    """The sets of whole blocks with their signatures and anchors: the shared ones among their first hashes, rarest first."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for d1, d2, n, held, data, graded in zip(*[c.to_pylist() for c in batch.columns]):
                values = np.frombuffer(data, np.uint64)
                grade = _grade_of(values, graded)
                rows, end = [], 0
                for k, size_k in enumerate(held):
                    own, rank = values[end:end + size_k], grade[end:end + size_k]
                    end += size_k
                    if not size_k:
                        continue
                    first = np.lexsort((own, rank))[:int(prefix(np.int64(n[k]), percent))]
                    rows.append((d1[k], d2[k], n[k], signature(own), own.tobytes(), own[first[rank[first] > 0]].view(np.int64).tolist()))
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 500]), (
                        pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=SETS.names)

    return _joined(stored, grades(stored, 1.0, size)).select("d1", "d2", "n", "held", "hashes", "graded").mapInArrow(run, SETS)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set numbers whose sets overlap enough."""
    named = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")).distinct()
    one = sets.select("sid", "n", "signature", "hashes").join(bounded_broadcast(named, 500_000), "sid", "left_semi")
    rows = pairs.join(one.toDF("a", "n", "sig", "set"), "a").join(one.toDF("b", "m", "sig_b", "set_b"), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            n, m = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            for i in range(batch.num_rows):
                sig, own, sig_b, other = (batch.column(c)[i].as_py() for c in (3, 4, 6, 7))
                if possible(int(n[i]), int(m[i]), sig, sig_b, percent):
                    x, y = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    kept[i] = enough(int((x[place] == y).sum()), int(n[i]), int(m[i]), percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in batch.columns[:2]], names=["a", "b"])

    return rows.select("a", "b", "n", "sig", "set", "m", "sig_b", "set_b").mapInArrow(run, "a long, b long")


def tiles(sets: DataFrame, percent: int) -> DataFrame:
    """(anchor, pos, band, own, sid, n): every set in the tiles of its anchors, in that of its own size band and the next one up."""
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    filed = sets.select("sid", "n", F.posexplode("anchors").alias("pos", "anchor"), own.alias("own"))
    return filed.select("anchor", "pos", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band"), "own", "sid", "n")


def fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def open_tiles(filed: DataFrame) -> DataFrame:
    """The members of tiles that hold sets of different components (column ``root``)."""
    counts = filed.groupBy("anchor", "band").agg(F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    return filed.join(counts.filter("r0 <> r1").select("anchor", "band", "members"), ["anchor", "band"])


def to_pivots(filed: DataFrame, percent: int, seed: int, pivots: int) -> DataFrame:
    """Pairs of every tile's members with some of them of other components, the least under several hashes."""
    heads = [F.min(F.struct(F.xxhash64("sid", F.lit(seed + k)).alias("h"), F.col("sid").alias("p"), F.col("n").alias("m"), F.col("root").alias("r"))).alias(f"p{k}")
             for k in range(pivots)]
    met = filed.join(filed.groupBy("anchor", "band").agg(*heads), ["anchor", "band"])
    met = met.select("sid", "n", "root", F.explode(F.array(*[f"p{k}" for k in range(pivots)])).alias("e")).filter(
        (F.col("e.r") != F.col("root")) & fits(F.col("n"), F.col("e.m"), percent))
    return met.select(F.greatest("sid", "e.p").alias("a"), F.least("sid", "e.p").alias("b")).distinct()


NAMES = ("g", "anchor", "band", "i", "j", "part", "sid", "n", "root", "own", "signature")


def within_tiles(filed: DataFrame, sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Candidate pairs of different components in open tiles (anchor, pos, band, own, sid, n, root, members).

    Tiles are dealt into parts of about ``tile`` members; a member goes to one group for each part that its own is
    compared with. A pair meets in the tiles of all its common anchors and is a candidate in one: that of the first
    of them, and of the larger set's band.
    """
    parts = F.ceil(F.col("members") / tile).cast("int")
    rows = filed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("sid", "anchor"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "anchor", "pos", "band", "own", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sid", "n", "root")
    rows = rows.join(sets.select("sid", "signature", "anchors"), "sid").withColumn("g", F.xxhash64("anchor", "band", "i", "j")).withColumn(
        "before", F.slice("anchors", F.lit(1), F.col("pos")))

    def run(batches):
        import pyarrow as pa

        def pairs():
            part, sid, n, root, own = (np.array([h[c] for h in held], np.int64) for c in (2, 3, 4, 5, 6))
            _, band, i, j = held[0][1]
            size = min(len(h[7]) for h in held)
            bits = np.stack([folded(h[7], size) for h in held])
            before: dict[int, frozenset] = {}

            def earlier(k: int) -> frozenset:
                if k not in before:
                    before[k] = frozenset(held[k][8].tolist())
                return before[k]

            out = []
            for x in range(len(held)):
                y = np.flatnonzero((sid > sid[x]) & (root != root[x]) & ((part != part[x]) | (i == j)) & (np.maximum(own, own[x]) == band)
                                   & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
                if len(y):
                    apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1).astype(np.int64)
                    shared = np.maximum(0, n[y] + n[x] - apart) // 2
                    y = y[100 * shared >= percent * (n[y] + n[x] - shared)]
                    out += [(sid[k], sid[x]) for k in y.tolist() if earlier(x).isdisjoint(earlier(k))]
            found = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held: list = []
        for batch in batches:
            lists = batch.column("before")
            anchors, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows = zip(*[batch.column(c).to_pylist() for c in NAMES])
            for at, (g, anchor, band, i, j, *rest) in enumerate(rows):
                key = (g, (anchor, band, i, j))
                if held and held[0][:2] != key:
                    yield pairs()
                    held.clear()
                held.append((*key, *rest, anchors[ends[at]:ends[at + 1]]))
        if held:
            yield pairs()

    width = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*NAMES, "before").repartition(width, "g")
    return dealt.sortWithinPartitions("g", "anchor", "band", "i", "j").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, share: float = COUNTED, block: int = BLOCK,
                       size: int = RANGE, tile: int = TILE) -> DataFrame:
    """Every document with the size of its shingle set and its component over links of ``percent`` in a hundred.

    Returns doc_id, n_shingles and component_id (the smallest doc_id reachable over links, itself included). Documents link when
    100 x shared >= percent x united. Null, empty and blank texts: no shingles, linked with nothing. Repeated rows: each is
    returned; equal texts link. Null doc_id: its component is that of the others, null if there are none; without words null.
    Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("key"))
    first = materialize(blocks(rows, shingle, share, block), "jaccard-blocks")
    each = first.select("block", F.posexplode(F.arrays_zip("doc_ids", "n", "d1", "d2", "keys"))).select(
        "block", F.col("pos").alias("at"), F.col("col.doc_ids").alias("doc_id"), F.col("col.n").alias("n"), F.col("col.d1").alias("d1"),
        F.col("col.d2").alias("d2"), F.col("col.keys").alias("key"))
    each = materialize(each, "jaccard-each")
    able = materialize(surviving(first, share, size, percent), "jaccard-able")
    discard(first)
    # One text of each set that may have a partner is read again.
    keys = each.join(able, ["block", "at"]).groupBy("d1", "d2").agg(F.min("key").alias("key")).select("key")
    keys = materialize(keys, "jaccard-keys")
    again = rows.join(bounded_broadcast(keys, 500_000), "key", "left_semi")
    second = materialize(blocks(again, shingle, 1.0, block), "jaccard-second")
    sets = materialize(anchored(second, size, percent).withColumn("sid", F.monotonically_increasing_id()), "jaccard-sets")
    discard(second)
    numbered = materialize(sets.groupBy("d1", "d2").agg(F.min("sid").alias("sid")), "jaccard-numbers")  # of equal sets one is filed
    filed = tiles(sets.select("sid", "n", "anchors").join(numbered.select("sid"), "sid", "left_semi"), percent)
    filed = materialize(filed.withColumn("root", F.col("sid")), "jaccard-tiles")
    filed = materialize(open_tiles(filed), "jaccard-open")
    links = None
    for r, pivots in enumerate(PIVOTS):
        more = materialize(verified(materialize(to_pivots(filed, percent, 100 * r, pivots), "jaccard-pivots"), sets, percent), "jaccard-links")
        links = more if links is None else links.unionAll(more)
        named = components(links)
        rooted = filed.drop("root", "members").join(named.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        filed = materialize(open_tiles(rooted), "jaccard-open")
    pairs = materialize(within_tiles(filed, sets, percent, tile), "jaccard-pairs")
    more = materialize(verified(pairs, sets, percent), "jaccard-more")
    if more.limit(1).count():
        named = components(links.unionAll(more))
    classes = numbered.join(named, F.col("sid") == F.col("node"), "left").select("d1", "d2", F.coalesce("root", "sid").alias("root"))
    smallest = each.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least")).join(classes, ["d1", "d2"], "left")
    smallest = materialize(smallest, "jaccard-classes")
    groups = smallest.filter("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    ids = smallest.join(groups, "root", "left").select("d1", "d2", F.coalesce("of_root", "least").alias("component"))
    out = each.join(ids, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
