"""Toxicity by the nearest labelled examples.

Labelled examples are TF-IDF vectors over all their words, with document frequencies from the whole table. Terms
that mark toxic texts (words and their first four to seven letters, chosen by their counts in the learning fold) make up a second part of a
vector; each part has unit length and a text with marked terms gives them a fixed share, so a few such words
aren't lost among many others. The cosine is that of the whole vectors.

An inverted index holds the examples in blocks; a term's postings in a block form a run with its largest weight. The maxima bound what a
block can score: a query scores its best blocks, then every block whose bound reaches the k-th score so far, so the k
nearest by cosine are exact. The texts here are alike in their words, so small blocks spare half of the postings but cost more than they
spare: a block holds ``BLOCK`` examples, usually all. They vote with their cosine, and the votes are calibrated on the
learning examples, each judged by the others. The neighbours are returned as evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .labelled import fold, sample

FOLDS, HELD = 4, 2
EXAMPLES = 20_000
INDEXED = 3_000
TERMS = 20_000
MARKED = 0.8
NEIGHBOURS = 15
BLOCK = 4096
THRESHOLD = 0.3
SUPPORT = 3
LIFT = 3.0
STEMS = (4, 5, 6, 7)
WORD = re.compile(r"\w+")
FLUSH = 100_000


def terms_of(word: str) -> list[str]:
    """A word and its stems; a stem is marked by a trailing star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


class Vocabulary:
    """The examples' words and the marked terms, their idf, and the beginnings by which most words are no marked ones."""

    def __init__(self, words: list[str], idf: np.ndarray, marked: list[tuple[str, float]]) -> None:
        # the words of most texts first: what is looked up most lies together
        self.words = {words[i]: i for i in np.argsort(np.asarray(idf), kind="stable").tolist()}
        self.marked = {t: len(words) + i for i, (t, _) in enumerate(marked)}
        self.idf = np.concatenate([np.asarray(idf, np.float64), np.array([w for _, w in marked], np.float64)])
        self.starts = {t.rstrip("*")[:STEMS[0]] for t, _ in marked}

    def __len__(self) -> int:
        return len(self.idf)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Term ids (ascending), unit weights, and whether there is a marked term, of a whole text."""
        counts = Counter(WORD.findall(text.lower()))
        known = self.words.get
        at = np.fromiter(map(known, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        at, n = at[at >= 0], n[at >= 0]
        order = np.argsort(at)
        at, weight = at[order], (1 + np.log(n[order])) * self.idf[at[order]]
        weight /= np.linalg.norm(weight) or 1.0
        hits: Counter[int] = Counter()
        cut, starts, marked = STEMS[0], self.starts, self.marked
        for word, times in counts.items():
            if word[:cut] in starts:
                for term in terms_of(word):
                    if term in marked:
                        hits[marked[term]] += times
        if not hits:
            return at, weight, False
        more = np.array(sorted(hits), np.int64)
        extra = np.array([1 + math.log(hits[i]) for i in more], np.float64) * self.idf[more]
        extra *= math.sqrt(MARKED if len(at) else 1.0) / (np.linalg.norm(extra) or 1.0)
        return np.concatenate([at, more]), np.concatenate([weight * math.sqrt(1 - MARKED), extra]), True


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Examples in blocks; each term's postings in a block are a run with its largest weight."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> None:
        # blocks of texts of one language: the term that most examples share tells it, and other languages' blocks get low bounds
        shared = np.bincount(np.concatenate([v[0] for v in vectors]), minlength=n_terms) if vectors else np.zeros(0, np.int64)
        order = sorted(range(len(ids)), key=lambda i: (
            int(vectors[i][0][np.argmax(shared[vectors[i][0]])]), int(vectors[i][0][np.argmax(vectors[i][1])]), int(ids[i])))
        self.ids, self.labels = ids[order], labels[order].astype(np.float64)
        vectors = [vectors[i] for i in order]
        sizes = [len(v[0]) for v in vectors]
        terms = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weights = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        place = np.repeat(np.arange(len(vectors)), sizes)
        self.n_blocks = max(1, -(-len(vectors) // block))
        key = terms * self.n_blocks + place // block
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.place, self.weight = place[order], weights[order]
        first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.run_start = np.append(first, len(key)).astype(np.int32)
        most = np.maximum.reduceat(self.weight, first) if len(key) else np.zeros(0)
        self.run_max = np.nextafter(most.astype(np.float32), np.float32(np.inf))  # not below the weight
        self.run_block = (key[first] % self.n_blocks).astype(np.int32)
        self.term_runs = np.searchsorted(key[first] // self.n_blocks, np.arange(n_terms + 1))

    def _scores(self, runs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        sizes = (self.run_start[runs + 1] - self.run_start[runs]).astype(np.int64)
        at = spread(self.run_start[runs], sizes)
        return np.bincount(self.place[at], np.repeat(weight, sizes) * self.weight[at], len(self.ids))

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term, nearest first, ties to the
        earlier place; the example with id ``skip`` is left out."""
        sizes = self.term_runs[at + 1] - self.term_runs[at]
        runs, weight = spread(self.term_runs[at], sizes), np.repeat(weight, sizes)
        if not len(runs):
            return np.zeros(0, np.int64), np.zeros(0)
        block = self.run_block[runs]
        bound = np.bincount(block, weight * self.run_max[runs], self.n_blocks)
        lead = np.zeros(self.n_blocks, bool)
        lead[np.argsort(-bound, kind="stable")[:2 + k // BLOCK]] = True
        scores = self._scores(runs[lead[block]], weight[lead[block]])
        out = self.ids == skip if skip is not None else np.zeros(len(self.ids), bool)
        reached = np.where(out, 0, scores)
        least = np.partition(reached, len(reached) - k)[len(reached) - k] if len(reached) >= k else 0.0
        rest = ~lead & (bound >= least - 1e-12)
        if rest.any():
            scores = scores + self._scores(runs[rest[block]], weight[rest[block]])
        scores = np.where(out, 0, scores)
        places = np.flatnonzero(scores > 0)
        if len(places) > k:
            places = places[scores[places] >= np.partition(scores[places], len(places) - k)[len(places) - k]]
        places = places[np.lexsort((places, -scores[places]))[:k]]
        return places, scores[places]


@dataclass
class Model:
    vocabulary: Vocabulary
    index: Index
    base: float
    silent: float
    levels: list[tuple[float, float]]
    held: object = None

    def shared(self, spark) -> Callable[[], Model]:
        """How a task gets the model: words and index are broadcast once, of bounded size; the rest goes along."""
        if self.held is None:
            self.held = spark.sparkContext.broadcast((self.vocabulary, self.index))
        held, rest = self.held, (self.base, self.silent, self.levels)
        return lambda: Model(*held.value, *rest)

    def vote(self, cosines: np.ndarray, labels: np.ndarray) -> float:
        return float((cosines @ labels + 0.5 * self.base) / (cosines.sum() + 0.5))

    def calibrated(self, vote: float) -> float:
        if not self.levels:
            return vote
        return float(np.interp(vote, [v for v, _ in self.levels], [p for _, p in self.levels]))

    def voted(self, text: str | None, skip: int | None = None) -> tuple[float | None, np.ndarray, np.ndarray, bool]:
        """The vote on a text (None without neighbours), its neighbours' places and cosines, and whether it has a marked term."""
        at, weight, marked = self.vocabulary.vector(text or "")
        places, cosines = self.index.nearest(at, weight, skip=skip)
        return self.vote(cosines, self.index.labels[places]) if len(places) else None, places, cosines, marked

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        vote, places, cosines, _ = self.voted(text)
        return self.silent if vote is None else self.calibrated(vote), self.index.ids[places].tolist(), cosines.tolist()


def isotonic(votes: np.ndarray, labels: np.ndarray) -> list[tuple[float, float]]:
    """Calibration points: rising means of the labels over the votes (pooled neighbours), one smoothing row each."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # sum of votes, sum of labels, rows
    for v, y in zip(votes[order], labels[order]):
        pools.append([float(v), float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v2, y2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + y2, pools[-1][2] + n2]
    return [(v / n, (y + 0.5 * (v / n)) / (n + 0.5)) for v, y, n in pools]


def choose_terms(learn: DataFrame, n: int, base: float, terms: int = TERMS) -> list[tuple[str, float]]:
    """(term, idf) of terms whose share of label 1 lies far above the base rate, at most ``terms``.

    Counted over all learning texts; each task adds up what it has read before anything is shuffled. A term
    must also follow several different words in texts of label 1: what near copies of one text
    share, however many they are, mostly follows one. The share must exceed the base rate by more than chance
    would bring about in any one of the counted terms (Chernoff's bound, over all of them).
    """
    def count(batches):
        import pyarrow as pa

        def flushed():
            out = pa.RecordBatch.from_arrays([
                pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()),
                pa.array([hit[t] for t in total], pa.int64()), pa.array([after.get(t, 0) for t in total], pa.int64())],
                names=["term", "n", "hits", "after"])
            total.clear()
            hit.clear()
            after.clear()
            return out

        total: Counter[str] = Counter()
        hit: Counter[str] = Counter()
        after: dict[str, int] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                found = {t for w in set(words) for t in terms_of(w)}
                total.update(found)
                if label:
                    hit.update(found)
                    for before, word in zip(["", *words], words):
                        bit = 1 << zlib.crc32(before.encode()) % 63
                        for t in terms_of(word):
                            after[t] = after.get(t, 0) | bit
                if len(total) > FLUSH:
                    yield flushed()
        yield flushed()

    counts = learn.select("label", "text").mapInArrow(count, "term string, n long, hits long, after long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.bit_count(F.bit_or("after")).alias("contexts"))
    counts = materialize(counts.filter(F.least("hits", "contexts") >= SUPPORT), "toxic-terms")
    share = F.col("hits") / F.col("n")
    other = F.when(share < 1, (F.col("n") - F.col("hits")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    gain = F.col("hits") * F.log(share / base) + other
    chosen = counts.withColumn("gain", gain).filter((share >= min(0.5, LIFT * base)) & (F.col("gain") >= math.log(max(1, counts.count()))))
    rows = chosen.orderBy(F.desc("gain"), "term").limit(terms).collect()
    return [(r["term"], math.log((1 + n) / (1 + r["n"])) + 1) for r in rows]


def document_counts(docs: DataFrame, words: list[str]) -> np.ndarray:
    """In how many of all documents each of the words is. A task sends one number for each word at most."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def count(batches):
        import pyarrow as pa

        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)  # the last place: words that are not asked for
        for batch in batches:
            for text in batch.column(0):
                found = set(WORD.findall((text.as_py() or "").lower()))
                total[np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))] += 1
        total = total[:-1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    summed = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(words), np.int64)
    out[summed.column("word").to_numpy()] = summed.column("n").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS, indexed: int = INDEXED) -> Model:
    """The model of the learning fold. Of at most about ``examples`` labelled texts, which choose at most ``terms`` marked
    terms and calibrate the votes, about ``indexed`` by a hash of the id are the neighbours."""
    learn = sample(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != HELD, examples)
    n, hits = learn.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = hits / n if n else 0.0
    if not 0 < base < 1:
        return Model(Vocabulary([], np.zeros(0), []), Index(np.zeros(0, np.int64), np.zeros(0), [], 0), base, base, [])
    cells = 1 << 30
    near = learn.select(F.col("doc_id").cast("long"), "label", "text").filter(
        F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(cells)) < int(cells * min(1.0, indexed / n)))
    def words_of(batches):
        import pyarrow as pa

        seen: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(WORD.findall(text.lower()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["word"])

    found = near.select("text").mapInArrow(words_of, "word string").distinct()
    words = sorted(found.toArrow().column("word").to_pylist())  # of ``indexed`` texts
    total = docs.filter(F.col("text").isNotNull()).count()
    idf = np.log((1 + total) / (1 + document_counts(docs, words))) + 1
    vocabulary = Vocabulary(words, idf, choose_terms(learn, n, base, terms))
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            found = [known.value.vector(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:2], pa.array([a.tolist() for a, _, _ in found], pa.list_(pa.int64())),
                pa.array([w.tolist() for _, w, _ in found], pa.list_(pa.float64()))], names=["doc_id", "label", "at", "weight"])

    rows = near.mapInArrow(vectors, "doc_id long, label int, at array<long>, weight array<double>").toArrow()  # of ``indexed`` texts
    known.destroy()
    held = [r for r in range(rows.num_rows) if len(rows.column("at")[r])]
    index = Index(rows.column("doc_id").to_numpy()[held], rows.column("label").to_numpy()[held],
                  [tuple(np.asarray(rows.column(c)[r].values) for c in ("at", "weight")) for r in held], len(vocabulary))
    model = Model(vocabulary, index, base, base, [])
    in_task = model.shared(spark)

    def votes(batches):
        import pyarrow as pa

        own = in_task()
        for batch in batches:
            found = [own.voted(t, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[3] for f in found])],
                                             names=["label", "vote", "marked"])

    # each learning example is judged by the others
    judged = learn.select(F.col("doc_id").cast("long"), "label", "text").repartition(16, "doc_id").mapInArrow(
        votes, "label int, vote double, marked boolean").toArrow()  # of ``examples`` texts
    label, vote = judged.column("label").to_numpy(), judged.column("vote").to_numpy(zero_copy_only=False)
    quiet = label[~judged.column("marked").to_numpy(zero_copy_only=False)]
    model.silent = (float(quiet.sum()) + base) / (len(quiet) + 1)
    voted = ~np.isnan(vote)
    # one made row at either end, so that a vote below all that were judged isn't taken for the lowest of them
    model.levels = isotonic(np.r_[0.0, vote[voted], 1.0], np.r_[0.0, label[voted].astype(np.float64), 1.0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours (doc_ids), cosines for every whole text."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("neighbours", T.ArrayType(T.LongType())),
        T.StructField("cosines", T.ArrayType(T.DoubleType()))])

    in_task = model.shared(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        own = in_task()
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.float64()),
                pa.array([f[1] for f in found], pa.list_(pa.int64())),
                pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=schema.names)

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "cosines")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document with a model of the labelled rows of the learning fold.

    Every text that shares a word with an indexed example has neighbours. The others, null and empty texts among them,
    get the rate of label 1 among learning texts without any marked term.
    Null doc_id: scored, not held out. Repeated rows: each is scored. No usable labels, or only one class:
    the base rate for all (0 if there are none). Empty table: no rows. Of other columns none is read.
    """
    return score(docs, fit(docs, labels))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, columns and values unchanged."""
    in_task = fit(docs, labels).shared(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        own = in_task()
        for batch in batches:
            kept = [own.score(t.as_py())[0] < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
