"""Resampling towards a target distribution by hashed n-gram importance.

Features are the words and word pairs of a text, hashed into buckets by the CRC-32 of their UTF-8 bytes. Each
task keeps an Aho-Corasick dictionary of distinct words between delimiters; a word's payload is its
CRC, the CRC with a blank after it, and its length. A scan emits payloads in order, and the CRC of a pair is composed
from two adjacent payloads, since appending n bytes is a linear map of the CRC before them. Words
that the dictionary lacks are hashed directly and enter it when it is next built.

Bucket counts of the corpus and of the target give each bucket a gain; a document's weight is its mean
gain. Gumbel noise from the document's id turns the weights into a draw without replacement: the
highest scores are drawn.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BUCKETS = 10_000
ORDER = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
WORDS = 200_000
FIRST = 2_000
PART = 2_000_000

# Bytes as the words see them: A-Z lower-cased, other ASCII than letters and digits a blank, the rest as it is.
SEEN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def appenders(bits: int = 31) -> np.ndarray:
    """For k below ``bits``, tables (4 x 256) of the map that appending 2**k zero bytes is to a CRC."""
    basis = np.array([1 << i for i in range(32)], np.uint64)
    for _ in range(8):  # one zero byte
        basis = (basis >> np.uint64(1)) ^ np.where(basis & np.uint64(1), np.uint64(POLYNOMIAL), np.uint64(0))
    out = np.zeros((bits, 4, 256), np.uint32)
    for k in range(bits):
        for byte in range(4):
            for i in range(8):
                out[k, byte, 1 << i:2 << i] = out[k, byte, :1 << i] ^ np.uint32(basis[8 * byte + i])
        basis = appended(basis.astype(np.uint32), out[k]).astype(np.uint64)  # twice as many bytes
    return out


def appended(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def composed(before: np.ndarray, after: np.ndarray, lengths: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRCs of joined byte strings from the CRCs of both parts and the lengths of the second."""
    out = before.copy()
    for k in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        here = (lengths >> k & 1).astype(bool)
        out[here] = appended(out[here], tables[k])
    return out ^ after


class Dictionary:
    """Words with their payloads, and the automaton over those that were known when it was last built."""

    def __init__(self, limit: int = WORDS) -> None:
        self.limit, self.tables = limit, appenders()
        self.built, self.automaton = 0, None
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.crc = np.zeros(1 << 12, np.uint32)
        self.blank = np.zeros(1 << 12, np.uint32)
        self.length = np.zeros(1 << 12, np.int64)
        self.built, self.automaton = 0, None

    def enter(self, word: str) -> int:
        place = len(self.places)
        if place == len(self.crc):
            self.crc, self.blank, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.crc, self.blank, self.length))
        data = word.encode("latin-1")
        crc = zlib.crc32(data)
        self.crc[place], self.blank[place], self.length[place] = crc, zlib.crc32(b" ", crc), len(data)
        self.places[word] = place
        return place

    def build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, place in self.places.items():
            self.automaton.add_word(f" {word} ", place)
        self.automaton.make_automaton()
        self.built = len(self.places)

    def scan(self, data: bytes) -> np.ndarray:
        """Places of the words of a text (whose bytes are as in ``SEEN``), in order."""
        data = b" " + data + b" "
        text = data.decode("latin-1")  # one character for each byte
        filled = np.frombuffer(data, np.uint8) != 32
        ends = np.flatnonzero(filled[:-1] & ~filled[1:]) + 1  # the delimiter after each word
        if not len(ends):
            return np.zeros(0, np.int64)
        places = np.full(len(ends), -1, np.int64)
        if self.automaton is not None:
            hits = np.array(list(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            if len(hits) == len(ends):
                return hits[:, 1]
            places[np.searchsorted(ends, hits[:, 0])] = hits[:, 1]
        rest = np.flatnonzero(places < 0)
        starts = np.flatnonzero(~filled[:-1] & filled[1:]) + 1
        for i, a, b in zip(rest.tolist(), starts[rest].tolist(), ends[rest].tolist()):
            word = text[a:b]
            place = self.places.get(word)
            places[i] = self.enter(word) if place is None else place
        return places

    def features(self, texts: list[bytes | None], buckets: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and all their features' buckets in the order of the texts."""
        if len(self.places) > 4 * self.limit:
            self.clear()
        if self.built < self.limit and len(self.places) > max(FIRST, 2 * self.built):
            self.build()
        found = [self.scan(t.translate(SEEN)) if t else np.zeros(0, np.int64) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        places = np.concatenate(found) if found else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        crc, length = self.crc[places], self.length[places]
        out, owners = [crc], [owner]
        run, last = crc, owner
        for n in range(1, order):  # runs of n + 1 words from runs of n
            same = owner[n:] == owner[:-n]
            if n == 1:
                before = self.blank[places[:-1]]
            else:
                before = composed(run, np.full(len(run), zlib.crc32(b" "), np.uint32), np.ones(len(run), np.int64), self.tables)[:len(places) - n]
            whole = composed(before, crc[n:], length[n:], self.tables)
            out.append(whole[same])
            owners.append(owner[n:][same])
            run = whole
        owner = np.concatenate(owners)
        features = np.concatenate(out) % np.uint32(buckets)
        return sizes, features[np.argsort(owner, kind="stable")].astype(np.uint16)


def features(rows: DataFrame, keep: list[str], text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """``keep``, n_words, n_features and ``buckets`` (two bytes for each feature) of every whole text."""
    if buckets > 1 << 16:
        raise ValueError("at most 65536 buckets")
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known = Dictionary()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(keep))), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:  # parts of bounded size
                end, total = at, 0
                while end < batch.num_rows and (end == at or total < PART):
                    total += int(sizes[end])
                    end += 1
                words, codes = known.features(batch.column(len(keep)).slice(at, end - at).to_pylist(), buckets, order)
                n = np.maximum(0, sum(np.maximum(0, words - k) for k in range(order)))
                edges = np.concatenate([[0], np.cumsum(n)])
                data = codes.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(at, end - at) for i in range(len(keep))], pa.array(words), pa.array(n.astype(np.int64)),
                    pa.array([data[2 * a:2 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())], names=schema.names)
                at = end

    return rows.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows; a task sends one row for each bucket at most."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_py(), "<u2"), minlength=buckets) if len(data.as_py()) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    summed = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the corpus, smoothed by one, floored."""
    buckets = len(own)
    all_own, all_target = float(own.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_own / (float(s + 1) * all_target)))
                     for s, t in zip(own.tolist(), target.tolist())], np.int64)


def weighed(found: DataFrame, keep: list[str], gain: np.ndarray) -> DataFrame:
    """``keep``, n_words, n_features and the floored mean gain of every row's features (0 without any)."""
    schema = T.StructType([*[found.schema[c] for c in keep], T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column(len(keep) + 1).to_numpy()
            sums = np.array([int(gain[np.frombuffer(d.as_py(), "<u2")].sum()) for d in batch.column(len(keep) + 2)], np.int64)
            weight = np.where(n > 0, np.floor_divide(sums, np.maximum(n, 1)), 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 2], pa.array(weight)], names=schema.names)

    return found.select(*keep, "n_words", "n_features", "buckets").mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, order: int = ORDER,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document with its importance for the target's distribution, and its rank if it is drawn.

    Returns doc_id, n_features, weight (thousandths of a nat), score (weight and Gumbel noise by the id) and rank
    (1, 2, 3 ... by falling score, ties to the smaller doc_id; null if not drawn). Drawn are ``percent`` in a
    hundred of the documents with ``min_words`` words or more. Null and empty texts: no features, weight 0, not drawn. Null doc_id: null score, not
    drawn and not among those counted. Repeated rows: each is a document, drawn by itself. Empty table: no rows;
    empty target: all its buckets count 0. Other columns are not read.
    """
    found = materialize(features(docs, ["doc_id"], text, buckets, order), "resample-features")
    # the target may be one file of any number of texts; its features are only counted
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, [], target_text, buckets, order), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed(found, ["doc_id"], gain).withColumn("score", F.col("weight") + noise).withColumn(
        "able", (F.col("n_words") >= min_words) & F.col("score").isNotNull())
    scored = materialize(scored, "resample-scores")
    able = scored.filter("able")
    drawn = able.count() * percent // 100
    # Scores are whole numbers between bounds that the gains and the noise set, under 100,000 of them.
    places = able.groupBy("score").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).filter(F.col("before") < drawn)
    places = materialize(places.select(F.col("score").alias("_score"), "before"), "resample-places")
    near = F.col("able") & F.col("before").isNotNull()
    placed = scored.join(F.broadcast(places), F.col("score") == F.col("_score"), "left").withColumn("near", near)
    within = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    rank = F.col("before") + F.row_number().over(within)
    top = placed.filter("near").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = placed.filter("not near").withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return top.select(*columns).unionAll(rest.select(*columns))


SQL = f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, list_transform(range(8), lambda k: k::BIGINT)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}::BIGINT) ELSE c // 2 END)) AS t),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (
  SELECT kind, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM split),
distinct_runs AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM runs),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM distinct_runs, steps),
counted AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM runs JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counted),
gains AS (
  SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (a.s + {BUCKETS}) / ((c.s + 1)::DOUBLE * (a.t + {BUCKETS}))))::BIGINT AS gain
  FROM counted c, sums a),
weights AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM runs JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (
  SELECT d.doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split d LEFT JOIN weights USING (r) WHERE d.kind = 0),
ranked AS (
  SELECT *, words >= {MIN_WORDS} AND score IS NOT NULL AS able,
    row_number() OVER (PARTITION BY words >= {MIN_WORDS} AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND place <= (SELECT count(*) FILTER (able) * {PERCENT} // 100 FROM ranked) THEN place END AS rank
FROM ranked
"""
