"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise interactions of all features have low rank, so a row is scored in time linear in its
features: half the sum over factors of (sum of v x) squared minus the sum of (v x) squared. Structure
statistics and the metadata (the recorded length and its agreement with the text) are cut into
quantile bins, each bin a feature; words are hashed and weighted by the root of their count.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import fold, sample

FOLDS, HELD = 5, 0
EXAMPLES = 12_000
WORD_BITS = 14
BINS = 12
RANK = 8
EPOCHS = 12
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3
SEED = 11
STATISTICS = (
    "words", "word_length", "distinct_words", "top_word", "distinct_pairs", "upper", "digits", "stops", "commas", "bangs",
    "bars", "signs", "other", "wide", "lines", "distinct_lines", "line_words", "short_words", "signed_words", "recorded", "agrees",
)


def statistics(text: str, words: list[str], counts: Counter[str], recorded: float | None) -> list[float]:
    """The structure statistics of a whole text, and its recorded length with how it agrees."""
    data = text.encode("utf-8", "surrogatepass")
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, chars = len(words), max(1, len(text))
    letters = max(1, int(of[65:91].sum() + of[97:123].sum()))
    lines = text.split("\n")
    stops, commas, bangs, bars = int(of[46] + of[63]), int(of[44] + of[59] + of[58]), int(of[33]), int(of[124])
    signs = int(of[35:39].sum() + of[42] + of[43] + of[61] + of[64] + of[94:96].sum() + of[126])
    other = int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) - stops - commas - bangs - bars - signs
    each = max(1, n)
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n), len(text) / each, len(counts) / each, max(counts.values(), default=0) / each, pairs / max(1, n - 1),
        int(of[65:91].sum()) / letters, int(of[48:58].sum()) / chars, stops / each, commas / each, bangs / each,
        bars / each, signs / each, other / each, int(of[192:].sum()) / chars, math.log1p(len(lines)),
        len(set(lines)) / len(lines), n / len(lines), sum(c for w, c in counts.items() if len(w) <= 2) / each,
        sum(c for w, c in counts.items() if not w[-1].isalnum()) / each,
        math.log1p(max(0.0, recorded)) if recorded is not None else -1.0,
        0.0 if recorded is None else float(recorded == len(text)),
    ]


def read(text: str | None, recorded: float | None, bits: int = WORD_BITS) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, hashed words and their unit weights of one text."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    mask = (1 << bits) - 1
    at = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & mask for w in counts), np.int64, len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    return statistics(text, words, counts, recorded), at, weight / (np.linalg.norm(weight) or 1.0)


@dataclass
class Rows:
    """Sparse rows: features, values and where each row ends."""

    at: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    def part(self, rows: np.ndarray) -> Rows:
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)
        return Rows(self.at[take], self.value[take], ends)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def rows(self, found: list[tuple[list[float], np.ndarray, np.ndarray]]) -> Rows:
        """Features: the words' hashes, then a bin of each statistic."""
        first = len(self.linear) - self.edges.shape[0] * (self.edges.shape[1] + 1)
        at, value = [], []
        for stats, words, weight in found:
            bins = [first + j * (self.edges.shape[1] + 1) + int(np.searchsorted(self.edges[j], s, side="right")) for j, s in enumerate(stats)]
            at.append(np.concatenate([words, np.array(bins, np.int64)]))
            value.append(np.concatenate([weight, np.ones(len(bins))]))
        ends = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64)
        return Rows(np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(value) if value else np.zeros(0), ends)

    def margins(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Margins by the sum-of-squares identity, and the factor sums of each row."""
        if len(rows.ends) == 1:
            return np.zeros(0), np.zeros((0, self.factors.shape[1]))
        scaled = self.factors[rows.at] * rows.value[:, None]
        starts = rows.ends[:-1]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), starts)
        linear = np.add.reduceat(self.linear[rows.at] * rows.value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, found: list[tuple[list[float], np.ndarray, np.ndarray]]) -> np.ndarray:
        margins, _ = self.margins(self.rows(found))
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def fit_machine(found: list[tuple[list[float], np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = WORD_BITS, rank: int = RANK,
                epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> Machine:
    """Logistic loss by AdaGrad over small batches."""
    stats = np.array([f[0] for f in found])
    edges = np.array([np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(stats.shape[1])])
    size = (1 << bits) + edges.shape[0] * (edges.shape[1] + 1)
    draw = np.random.default_rng(seed)
    mean = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    machine = Machine(float(np.log(mean / (1 - mean))), np.zeros(size), draw.normal(0, 0.01, (size, rank)), edges)
    rows = machine.rows(found)
    past, past_factors, past_bias = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), 64):
            chosen = order[at:at + 64]
            part = rows.part(chosen)
            margins, sums = machine.margins(part)
            error = 1 / (1 + np.exp(-np.clip(margins, -30, 30))) - labels[chosen]
            owner = np.repeat(np.arange(len(chosen)), np.diff(part.ends))
            push = error[owner] * part.value
            used, place = np.unique(part.at, return_inverse=True)
            step = np.bincount(place, push, len(used)) / len(chosen) + decay * machine.linear[used]
            each = push[:, None] * (sums[owner] - machine.factors[part.at] * part.value[:, None])
            steps = np.stack([np.bincount(place, each[:, r], len(used)) for r in range(rank)], 1) / len(chosen) + decay * machine.factors[used]
            past[used] += step * step
            past_factors[used] += steps * steps
            machine.linear[used] -= rate * step / np.sqrt(past[used])
            machine.factors[used] -= rate * steps / np.sqrt(past_factors[used])
            past_bias += error.mean() ** 2
            machine.bias -= rate * error.mean() / np.sqrt(past_bias)
    return machine


def recorded(docs: DataFrame) -> Column:
    """The recorded length as metadata, null where the table has none."""
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Machine | float:
    """The machine of the learning fold from at most about ``examples`` labelled texts; with fewer than two
    classes the base rate instead."""
    kept = docs.select("doc_id", "text", recorded(docs).alias("recorded"))
    learn = sample(kept, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD,
                   examples, ["recorded"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [read(t, r) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.float64())),
                pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                names=["label", "stats", "at", "weight"])

    table = learn.select("label", "text", "recorded").mapInArrow(
        run, "label int, stats array<double>, at array<long>, weight array<double>")
    taken = table.toArrow()  # bounded by ``examples``: features, not texts
    y = taken.column("label").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    order = np.lexsort((np.array([len(a) for a in taken.column("at")]), np.array([s[0].as_py() for s in taken.column("stats")]), y))
    stats, at, weight = (taken.column(c).combine_chunks() for c in ("stats", "at", "weight"))
    found = [(stats[int(i)].as_py(), at[int(i)].values.to_numpy(), weight[int(i)].values.to_numpy()) for i in order]
    return fit_machine(found, y[order])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document with a machine fitted on the labelled rows of the learning fold.

    Returns doc_id, held_out, score, predicted. Null and empty texts are scored as texts without words.
    Null doc_id: scored, not held out. Null or missing n_chars: a metadata bin of its own. Repeated
    rows: each is scored. No usable labels or one class: the base rate for all (0 if there are none).
    Empty table: no rows. Other columns are not read.
    """
    machine = fit(docs, labels)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if isinstance(machine, float):
                    scores.append(np.full(part.num_rows, machine))
                    continue
                scores.append(machine.score([read(t.as_py(), r.as_py()) for t, r in zip(part.column(1), part.column(2))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=schema.names)

    scored = docs.select("doc_id", "text", recorded(docs).alias("recorded")).mapInArrow(run, schema)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
