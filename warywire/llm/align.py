"""Alignment of two tokenizers' ids over the same bytes.

Both tokenizers encode a text; the cumulative byte lengths of their tokens are two sets of ends. Ends in both
sets, found by intersecting the end-to-index dictionaries, cut the two id lists into groups that
cover the same bytes. Within a group every id of one side is linked to every id of the other.

A text is a row of chunks (a word with the blank before it, what follows its letters, or a run of white space) between places that
neither tokenizer's tokens ever cross, so both lists end there and the groups of a text are its chunks'
groups in a row. Each distinct chunk is encoded and aligned once per worker. Where chunks can't be shown to
be independent, they stay together, in the worst case as one chunk for the whole text.

Texts are read once and kept in blocks: the block's distinct id pairs, the documents in the block that
hold each of them, and every document's pairs as places in that list. Counts of pairs are summed per task, then over
all tasks; they come back to the blocks in slices of bounded size.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import pieces

BYTES = "/opt/tokenizers/byte_bpe_50k.json"
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BLANK = re.compile(f"[{BLANKS}]")
LETTER = re.compile(r"[^\W\d_]")
MARKS = ",.;:"
BLOCK_CHARS = 1_000_000
CHUNKS = 450_000
SLICE = 2_000_000
FLUSH = 4_000_000


def align(lengths_a: list[int], lengths_b: list[int]) -> list[tuple[int, int]]:
    """The groups of two token lists over the same bytes: for each, the places after its last tokens.

    Tokens without bytes belong to the group before them, or to the first one.
    """
    a = dict(zip(accumulate(lengths_a), range(1, len(lengths_a) + 1)))
    b = dict(zip(accumulate(lengths_b), range(1, len(lengths_b) + 1)))
    return [(i, b[end]) for end, i in a.items() if end in b]  # ends rise, so the common ones come in order


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted: printable Latin-1
    bytes stand for themselves, the others follow from 256 on in order."""
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of their ids, and a table of aligned chunks."""

    def __init__(self, first: str, second: bytes, limit: int = CHUNKS) -> None:
        from tokenizers import Tokenizer, normalizers

        self.a = Tokenizer.from_str(first)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        rules = pieces.parse(second)
        self.b = pieces.build(rules)
        self.bytes_b: dict[int, bytes] = {}
        for i, (text, _, kind) in enumerate(rules.pieces):
            if kind == pieces.BYTE:
                self.bytes_b[i] = bytes([int(text[3:5], 16)])
            elif kind in (pieces.NORMAL, pieces.USER, pieces.UNUSED):
                self.bytes_b[i] = text.replace(pieces.MARK, " ").encode()
        self.width = len(rules.pieces)
        self.whole = set(alphabet) <= set(self.a.get_vocab(with_added_tokens=False))  # then A's tokens give back any bytes
        self.spans_a = [len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)]
        self.spans_b = [len(self.bytes_b.get(i, b"")) for i in range(self.width)]
        self.apart = (rules.dummy_prefix and rules.escape_blanks and not rules.strip_blanks and not rules.charsmap
                      and rules.kind == pieces.BPE and self.b.pre_tokenizer is not None)
        joined = set(chain.from_iterable(t for t, _, kind in rules.pieces if len(t) > 1 and kind in (pieces.NORMAL, pieces.USER, pieces.UNUSED)))
        self.lone = {c for c in map(chr, (*range(9, 14), 0x85, 0xA0)) if c not in joined}  # blanks that no longer piece holds
        held = {b for t, _, _ in rules.pieces for a, b in zip(t, t[1:]) if LETTER.match(a)}
        self.marks = "".join(c for c in MARKS if c not in held)  # no piece goes on from a letter to one of these
        word = rf" ?[^\W\d_]++(?=[{re.escape(self.marks)}])|" if self.marks else ""
        self.chunk = re.compile(f"{word} ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
        self.odd = re.compile(f"  |(?![ {re.escape(''.join(sorted(self.lone)))}])[{BLANKS}]")
        if self.apart:
            self.b.normalizer = normalizers.Sequence([])
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.numbers = array("q")  # n_a, n_b, n_groups, n_links and 1 (0 if the bytes differ) for each chunk
        self.codes, self.times, self.ends = array("q"), array("q"), array("q")  # linked pairs, and where each chunk's end

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text with the blank before it."""
        text = " " + text
        if not self.apart:
            return [text]
        parts = self.chunk.findall(text)
        if not self.odd.search(text):
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            last = out[-1]
            blank = BLANK.match(last[-1]) is not None
            cut = (part[0] == " " and not blank) or last[-1] in self.lone or part[0] in self.lone or (
                part[0] in self.marks and LETTER.match(last[-1]) is not None)
            if cut:
                out.append(part)
            else:
                out[-1] = last + part
        return out

    def add(self, chunks: list[str]) -> None:
        found_a = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        marked = [c.replace(" ", pieces.MARK) for c in chunks] if self.apart else [c[1:] for c in chunks]
        found_b = self.b.encode_batch_fast(marked, add_special_tokens=False)
        for text, a, b in zip(chunks, found_a, found_b):
            self.index[text] = len(self.groups)
            self.enter(text.encode(), a.ids, b.ids)

    def enter(self, text: bytes, ids_a: list[int], ids_b: list[int]) -> None:
        n_a, n_b = len(ids_a), len(ids_b)
        try:
            good = b"".join([self.bytes_b[i] for i in ids_b]) == text
            good = good and (self.whole or b"".join([self.bytes_a[i] for i in ids_a]) == text)
        except KeyError:  # a token without bytes of its own
            good = False
        if not good:
            self.numbers.extend((0, 0, 0, 0, 0))
            self.groups.append(b"")
            self.ends.append(len(self.codes))
            return
        if n_a == 1 or n_b == 1:
            ends = [(n_a, n_b)]
        else:
            spans_a, spans_b = self.spans_a, self.spans_b
            ends = align([spans_a[i] for i in ids_a], [spans_b[i] for i in ids_b])
        said, links, width, codes, times = [], 0, self.width, [], None
        at_a = at_b = 0
        for end_a, end_b in ends:
            if end_a == at_a + 1 and end_b == at_b + 1:
                i, j = ids_a[at_a], ids_b[at_b]
                said.append(f"{i}|{j}")
                codes.append(i * width + j)
                links += 1
            else:
                part_a, part_b = ids_a[at_a:end_a], ids_b[at_b:end_b]
                said.append(f"{','.join(map(str, part_a))}|{','.join(map(str, part_b))}")
                links += len(part_a) * len(part_b)
                if len(part_a) > 8 and len(part_b) > 8:  # equal ids of a long group are linked together
                    times = (times or []) + [1] * (len(codes) - len(times or []))
                    times_b = Counter(part_b)
                    for i, m in Counter(part_a).items():
                        codes += [i * width + j for j in times_b]
                        times += [m * n for n in times_b.values()]
                else:
                    codes += [i * width + j for i in part_a for j in part_b]
            at_a, at_b = end_a, end_b
        self.codes.extend(codes)
        self.times.extend(repeat(1, len(codes)) if times is None else times + [1] * (len(codes) - len(times)))
        self.numbers.extend((n_a, n_b, len(said), links, 1))
        self.groups.append(";".join(said).encode())
        self.ends.append(len(self.codes))

    def block(self, texts: list[str]) -> dict:
        """Numbers of each text, the block's pairs, and each text's pairs as places in that list with their times."""
        rows = [self.chunks(t) if t else [] for t in texts]
        if len(self.index) > self.limit or len(self.codes) > 20 * self.limit:
            self.clear()
        fresh = [c for c in set(chain.from_iterable(rows)) if c not in self.index]
        if fresh:
            self.add(fresh)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        table = np.frombuffer(self.numbers, np.int64).reshape(-1, 5)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        totals = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(table[at], axis=0)])
        totals = totals[edges[1:]] - totals[edges[:-1]]
        good = (totals[:, 4] == sizes) & (sizes > 0)
        totals[~good] = 0
        groups, starts = self.groups, edges.tolist()
        places = at.tolist()
        digests = [sha256(b";".join([groups[i] for i in places[starts[k]:starts[k + 1]]])).hexdigest() if good[k] else ""
                   for k in range(len(rows))]
        owner = np.repeat(np.arange(len(rows)), sizes)
        at, owner = at[good[owner]], owner[good[owner]]
        ends = np.frombuffer(self.ends, np.int64)
        first = np.where(at > 0, ends[at - 1], 0)
        spans = ends[at] - first
        whole = np.concatenate([[0], np.cumsum(spans)])
        flat = np.arange(whole[-1]) + np.repeat(first - whole[:-1], spans)
        codes, times = np.frombuffer(self.codes, np.int64)[flat], np.frombuffer(self.times, np.int64)[flat]
        pairs, place = np.unique(codes, return_inverse=True)
        # one entry for each text and pair
        entry, back = np.unique(np.repeat(owner, spans) * max(1, len(pairs)) + place, return_inverse=True)
        times = np.bincount(back, times, len(entry)).astype(np.int64)
        text, place = entry // max(1, len(pairs)), entry % max(1, len(pairs))
        return {"totals": totals[:, :4], "digests": digests, "pairs": pairs, "docs": np.bincount(place, minlength=len(pairs)),
                "sizes": np.bincount(text, minlength=len(rows)), "place": place, "times": times}


@lru_cache(maxsize=1)
def worker(first: str, second: bytes) -> Pair:
    return Pair(first, second)


def _small(values: np.ndarray) -> bytes:
    """The width in bytes, then the values, in the smallest unsigned type that holds them."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 256 ** int(k[2]))
    return kind[2].encode() + values.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, key: str, text: str, first: str, second: bytes, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each block of documents: their numbers and digests, and the pairs of the block."""
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), *[T.StructField(n, T.ArrayType(T.LongType())) for n in NUMBERS],
        T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("pairs", T.BinaryType()), T.StructField("docs", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()), T.StructField("place", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                end, total = at, 0
                while end < batch.num_rows and (end == at or total < chars):
                    total += int(sizes[end])
                    end += 1
                found = worker(first, second).block(batch.column(1).slice(at, end - at).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), batch.column(0).slice(at, end - at)),
                    *[pa.array([found["totals"][:, i].tolist()], pa.list_(pa.int64())) for i in range(4)],
                    pa.array([found["digests"]], pa.list_(pa.string())),
                    *[pa.array([_small(found[n])], pa.binary()) for n in ("pairs", "docs", "sizes", "place", "times")]], names=schema.names)
                at = end

    return docs.select(key, text).mapInArrow(run, schema)


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each id pair is linked."""
    def run(batches):
        import pyarrow as pa

        def summed():
            pairs, back = np.unique(np.concatenate(held), return_inverse=True)
            out = pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(back, np.concatenate(docs)).astype(np.int64))], names=["pair", "n"])
            held.clear()
            docs.clear()
            return out

        held: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        for batch in batches:
            for pairs, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(_wide(pairs).astype(np.int64))
                docs.append(_wide(n))
                if sum(map(len, held)) > FLUSH:
                    yield summed()
        if held:
            yield summed()

    return stored.select("pairs", "docs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(stored: DataFrame, kind: T.DataType, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """Documents with the sums over those of their links whose pair is in the slice. The slice is broadcast: at most about ``SLICE`` rows."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast((pairs, counts, best))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("key", kind),
        *[T.StructField(n, T.LongType()) for n in NUMBERS], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
        T.StructField("digest", T.StringType())])

    def run(batches):
        import pyarrow as pa

        pairs, counts, best = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                own = _wide(row["pairs"].as_py()).astype(np.int64)
                spot = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
                here = pairs[spot] == own if len(pairs) else np.zeros(len(own), bool)
                n = np.where(here, counts[spot] if len(pairs) else 0, 0)
                top = here & best[spot] if len(pairs) else here
                place, times = _wide(row["place"].as_py()).astype(np.int64), _wide(row["times"].as_py()).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(_wide(row["sizes"].as_py()).astype(np.int64))])
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * top[place], times * n[place])]
                size = len(edges) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, row["block"].as_py(), np.int64)), pa.array(np.arange(size, dtype=np.int32)), row["keys"].values,
                    *[row[c].values for c in NUMBERS], *[pa.array(s[edges[1:]] - s[edges[:-1]]) for s in sums], row["digests"].values],
                    names=schema.names)

    return stored.select("block", "keys", *NUMBERS, "digests", "pairs", "sizes", "place", "times").mapInArrow(run, schema)


def alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = BYTES, second: str = pieces.MODEL,
              slice_rows: int = SLICE, chars: int = BLOCK_CHARS) -> DataFrame:
    """Every document's aligned groups and links between a byte-level tokenizer (A) and a SentencePiece model (B).

    Returns ``key``, n_a, n_b (tokens), n_groups, n_links (pairs of token occurrences in one group), n_best (links whose
    id pair is linked in as many documents as any pair with that A id), count_sum (those document counts, over the
    links) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``). Both tokenizers read the text with a blank before it; strings of special
    tokens are plain text. Null and empty texts, and texts whose tokens' bytes differ from the text: zeros and
    ''. Repeated rows: each is returned, and counts as a document. Empty table: no rows. Other columns are not read.
    """
    with open(first) as f:
        known = f.read()
    data = pieces.read_model(second)
    if len(known) + len(data) > 64 << 20:
        raise ValueError("the tokenizer files are larger than 64 MB")
    pieces.verify(pieces.build(pieces.parse(data)), data)
    width = len(pieces.parse(data).pieces)
    stored = materialize(blocks(docs, key, text, known, data, chars).withColumn("block", F.monotonically_increasing_id()), "align-blocks")
    counts = pair_counts(stored).withColumn("a", F.floor(F.col("pair") / width).cast("long"))
    counts = materialize(counts, "align-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of A's vocabulary at most
    marked = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    n_slices = max(1, -(-counts.count() // slice_rows))
    parts = []
    for k in range(n_slices):
        one = marked.filter(F.pmod(F.xxhash64("pair"), F.lit(n_slices)) == k).toArrow().sort_by("pair")
        parts.append(_scored(stored, docs.schema[key].dataType, *[one.column(c).to_numpy() for c in ("pair", "n", "best")]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    if len(parts) > 1:
        out = out.groupBy("block", "at").agg(*[F.first(c).alias(c) for c in ("key", *NUMBERS)], F.sum("n_best").alias("n_best"),
                                             F.sum("count_sum").alias("count_sum"), F.first("digest").alias("digest"))
    return out.select(F.col("key").alias(key), *NUMBERS, "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
