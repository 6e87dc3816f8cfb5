"""URL filter: rules first, and a ratio of character language models where no rule fits.

Two smoothed variable-order Markov models, one of the URLs that the rules accept and one of those they
reject, give every character a probability from the longest context that was seen, interpolated with
the shorter ones. A URL's score is the difference of the two log-likelihoods per character; the threshold
is calibrated on accepted and rejected URLs that the models have not seen. Counts run over all such URLs;
the tables they are kept in have a fixed number of cells per order, so their size is bounded.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"))
"""(verdict, host, beginning of the path)."""

ORDER = 4
CELLS = 1 << 16
CHUNK = 4_000_000
HELD = 5
BINS = 400
RANGE = 8.0
START = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    cut = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(cut) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = url.isNotNull() & (at > 0)
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def rule_name(host: str, path: str) -> str:
    return host + path


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and begins the path; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: (len(rule_name(*r[1:])), r)):  # the longest is asked first
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, rule_name(domain, start)).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def cells(data: np.ndarray, ends: np.ndarray, order: int = ORDER, n_cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cells of (context, character) and of the context alone, per order 0 to ``order``: (order + 1, bytes).

    ``data`` holds the bytes of all urls one after another, ``ends`` their ends. Contexts begin anew at every url.
    """
    starts = np.concatenate([[0], ends[:-1]])
    since = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([[0], ends])))
    context = np.zeros(len(data), np.uint64)
    with_char, alone = np.zeros((order + 1, len(data)), np.int64), np.zeros((order + 1, len(data)), np.int64)
    with np.errstate(over="ignore"):
        for n in range(order + 1):
            if n:
                before = np.zeros(len(data), np.uint64)
                before[n:] = data[:-n]
                before[since < n] = START  # in front of a url
                context = (context ^ (before + np.uint64(n * 257))) * np.uint64(0x9E3779B97F4A7C15)
                context ^= context >> np.uint64(29)
            joined = (context ^ (data.astype(np.uint64) + np.uint64(0x51ED27))) * np.uint64(0xC2B2AE3D27D4EB4F)
            joined ^= joined >> np.uint64(32)
            with_char[n] = (joined % np.uint64(n_cells)).astype(np.int64)
            alone[n] = (((context + np.uint64(1)) * np.uint64(0x165667B19E3779F9) >> np.uint64(40)) % np.uint64(n_cells)).astype(np.int64)
    return with_char, alone


def packed(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(urls), np.uint8), np.cumsum([len(u) for u in urls], dtype=np.int64)


def parts(urls: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of urls of bounded size."""
    out, at, size = [], 0, 0
    for i, u in enumerate(urls):
        size += len(u)
        if size >= CHUNK:
            out.append((at, i + 1))
            at, size = i + 1, 0
    return [*out, (at, len(urls))] if at < len(urls) else out


@dataclass
class Model:
    """Counts of both classes (0 reject, 1 accept): of (context, character), of contexts, and of characters that
    followed a context for the first time; and the threshold."""

    pair: np.ndarray
    context: np.ndarray
    kinds: np.ndarray
    threshold: float = 0.0

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Accepted minus rejected log-likelihood per byte; 0 for an empty url."""
        out = np.zeros(len(urls))
        for first, last in parts(urls):
            data, ends = packed(urls[first:last])
            if not len(data):
                continue
            pair, alone = cells(data, ends, self.pair.shape[1] - 1, self.pair.shape[2])
            gain = np.zeros(len(data))
            for kind, sign in ((1, 1.0), (0, -1.0)):
                p = np.full(len(data), 1 / 256)
                for n in range(len(pair)):  # Witten-Bell: unseen kinds of followers weigh the shorter context
                    seen, kinds = self.context[kind, n, alone[n]], self.kinds[kind, n, alone[n]]
                    p = np.where(seen > 0, (np.minimum(self.pair[kind, n, pair[n]], seen) + kinds * p) / np.maximum(seen + kinds, 1), p)
                gain += sign * np.log(p)
            total = np.concatenate([[0.0], np.cumsum(gain)])
            size = np.diff(np.concatenate([[0], ends]))
            out[first:last] = (total[ends] - total[np.concatenate([[0], ends[:-1]])]) / np.maximum(size, 1)
        return out


def frozen(model: Model) -> bytes:
    """The model for the tasks, compressed: most cells are empty."""
    return zlib.compress(pickle.dumps(model), 1)


@lru_cache(maxsize=2)
def thawed(data: bytes) -> Model:
    return pickle.loads(zlib.decompress(data))


def accepted_and_rejected(pages: DataFrame) -> DataFrame:
    """(url, kind, held): URLs that a rule accepts (1) or rejects (0); a fifth, by hash, is kept for calibration."""
    host, path = host_and_path(F.col("url"))
    held = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(HELD)) == 0
    return pages.select(F.col("url").cast("binary").alias("url"), by_rules(host, path)[1].alias("verdict"), held.alias("held")).filter(
        "verdict is not null").select("url", (F.col("verdict") == "allow").cast("int").alias("kind"), "held")


def fit(pages: DataFrame, order: int = ORDER, n_cells: int = CELLS) -> Model | None:
    """Models of all URLs that rules decide; None where a class is missing.

    Tasks add their URLs' characters up in fixed tables and send the cells that are not zero; Spark sums
    those per cell, so at most 2 x 2 x (order + 1) x ``n_cells`` sums reach the driver.
    """
    known = accepted_and_rejected(pages)

    def count(batches):
        import pyarrow as pa

        pair, alone = np.zeros((2, order + 1, n_cells), np.int64), np.zeros((2, order + 1, n_cells), np.int64)
        for batch in batches:
            urls, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for kind in (0, 1):
                of = [u for u, k in zip(urls, kinds) if k == kind]
                for first, last in parts(of):
                    with_char, context = cells(*packed(of[first:last]), order, n_cells)
                    for n in range(order + 1):
                        pair[kind, n] += np.bincount(with_char[n], minlength=n_cells)
                        alone[kind, n] += np.bincount(context[n], minlength=n_cells)
        for table, counts in enumerate((pair, alone)):
            flat = counts.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), table, np.int32)), pa.array(at.astype(np.int64)), pa.array(flat[at])], names=["t", "cell", "n"])

    def kinds_of(batches):
        """A context's kinds of followers: one (context, follower) each, whatever its count."""
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            urls, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for kind in (0, 1):
                of = [u for u, k in zip(urls, kinds) if k == kind]
                for first, last in parts(of):
                    with_char, context = cells(*packed(of[first:last]), order, n_cells)
                    for n in range(order + 1):
                        base = (kind * (order + 1) + n) * n_cells
                        both = np.unique((base + context[n]) * n_cells + with_char[n])
                        seen.update(zip((both // n_cells).tolist(), (both % n_cells).tolist()))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in seen], pa.int64()), pa.array([s[1] for s in seen], pa.int64())], names=["cell", "pair"])
                    seen = set()
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in seen], pa.int64()), pa.array([s[1] for s in seen], pa.int64())], names=["cell", "pair"])

    learn = known.filter("not held").select("url", "kind")
    sums = learn.mapInArrow(count, "t int, cell long, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")).toArrow()
    kinds = learn.mapInArrow(kinds_of, "cell long, pair long").distinct().groupBy("cell").agg(F.count("*").alias("n")).toArrow()
    shape = (2, order + 1, n_cells)
    tables = []
    for which in (0, 1):
        flat = np.zeros(np.prod(shape))
        mine = sums.column("t").to_numpy() == which
        flat[sums.column("cell").to_numpy()[mine]] = sums.column("n").to_numpy()[mine]
        tables.append(flat.reshape(shape))
    follow = np.zeros(np.prod(shape))
    follow[kinds.column("cell").to_numpy()] = kinds.column("n").to_numpy()
    model = Model(*tables, follow.reshape(shape))
    if not all(model.context[kind, 0].sum() for kind in (0, 1)):
        return None
    model.threshold = calibrate(known.filter("held").select("url", "kind"), model)
    return model


def calibrate(held: DataFrame, model: Model) -> float:
    """The threshold that tells accepted from rejected held-out URLs best (equal weight for both classes)."""
    data = frozen(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            place = np.clip((thawed(data).scores(batch.column(0).to_pylist()) / RANGE + 0.5) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["bin", "kind"])

    found = np.zeros((2, BINS))
    for r in held.mapInArrow(run, "bin int, kind int").groupBy("bin", "kind").agg(F.count("*").alias("n")).collect():
        found[r["kind"], r["bin"]] = r["n"]
    if not found.sum(axis=1).all():
        return 0.0
    share = found / found.sum(axis=1, keepdims=True)
    right = np.concatenate([[0.0], np.cumsum(share[0])]) + (1 - np.concatenate([[0.0], np.cumsum(share[1])]))
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[len(best) // 2] / BINS - 0.5) * RANGE)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every url's host, path, rule and verdict.

    Returns page_id, host, path, rule (null where none fits), verdict (allow or block: the rule's, else
    the models'), score (accepted minus rejected log-likelihood per byte, also where a rule decides), threshold.
    Null or empty url: no rule, score 0. Where rules leave a class without URLs, what no rule fits is
    allowed and scores 0. Repeated rows: each is judged. Empty table: no rows. Other columns are not read.
    """
    model = fit(pages.select("url"))
    threshold = model.threshold if model else 0.0
    data = frozen(model) if model else None
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            urls = [(u or "").encode("utf-8", "surrogatepass") for u in batch.column(1).to_pylist()]
            scores = thawed(data).scores(urls) if data else np.zeros(len(urls))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=schema.names)

    host, path = host_and_path(F.col("url"))
    scored = pages.select("page_id", "url").mapInArrow(run, schema).select(
        "page_id", host.alias("host"), path.alias("path"), "score")
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score",
                         F.lit(threshold).alias("threshold"))
