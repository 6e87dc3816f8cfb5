"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; from it come the normaliser, the metaspace marker,
the pieces with their scores and the byte fallback of an equal ``tokenizers.Tokenizer``. A unigram
model keeps its scores; a BPE model's merges follow from the scores of the joined pieces. Batches
are encoded by several threads. Parity with the sentencepiece library is verified on probe texts
before a model is used, and on every row if asked.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BATCH_CHARS = 1_000_000


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_blanks: bool = True
    escape_blanks: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message: ints, 4-byte floats, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 1:
            value, at = data[at:at + 8], at + 8
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif wire == 5:
            value, at = struct.unpack("<f", data[at:at + 4])[0], at + 4
        else:
            raise ValueError(f"not a SentencePiece model: wire type {wire}")
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """Reads ModelProto: pieces (1), trainer (2) and normaliser (3) specs."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.strip_blanks = bool(v)
                elif n == 5:
                    model.escape_blanks = bool(v)
    if not model.pieces:
        raise ValueError("not a SentencePiece model: no pieces")
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Merge pairs of a BPE model, best first: every split of a piece into two pieces, in the order
    of the joined piece's score (higher first, then smaller id)."""
    ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    ranked = []
    for text, i in ids.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in ids and right in ids:
                ranked.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    ranked.sort()
    return [(left, right) for *_, left, right in ranked]


def build(model: Model):
    """An equal ``tokenizers.Tokenizer``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_blanks:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_blanks else " "))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    if model.kind == BPE:
        core = models.BPE(vocab={text: i for i, (text, _, _) in enumerate(model.pieces)}, merges=merges(model),
                          unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback,
                          ignore_merges=False)
    else:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces], model.unk_id, model.byte_fallback)
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    crossing = any(MARK in text.lstrip(MARK) for text, _, kind in model.pieces if kind in (NORMAL, USER))
    if not crossing:  # no piece goes on over a marker after other characters, so words are independent
        out.pre_tokenizer = pre_tokenizers.Split(Regex(WORD.pattern), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(parts)
    return out


PROBES = ("", " ", "Hello world", "  two  blanks ", "tab\tand\nline", "déjà vu Straße niño", "数学 и мир 🙂🪴",
          "a" * 300, "▁mark ▁", "x  y   z    w", "A!!B##c$$ 12,345.67", "\x00\x01 � ​ end", "<s> </s> <unk> <0x41>")


def verify(tokenizer, data: bytes, texts=PROBES) -> None:
    """Raises if the rebuilt tokenizer and the sentencepiece library differ on any of the texts."""
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in texts:
        ours = tokenizer.encode(text, add_special_tokens=False).ids
        if ours != reference.encode(text):
            raise ValueError(f"the rebuilt tokenizer differs from the model on {text[:80]!r}")
        if tokenizer.decode(ours, skip_special_tokens=False) != reference.decode(ours):
            raise ValueError(f"decoding differs from the model on {text[:80]!r}")


OUT = T.StructType([
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("round_trip", T.BooleanType()),
])


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Words:
    """Token ids of words, each distinct word encoded and decoded once.

    Where no piece goes on over a metaspace marker, a text's ids are its words' ids in a row, so a
    table of words gives exactly the ids of the whole text. The table starts anew at ``limit`` words.
    """

    def __init__(self, tokenizer, limit: int = 250_000) -> None:
        from tokenizers import normalizers

        tokenizer.normalizer = normalizers.Sequence([])  # words come with their marker
        self.tokenizer, self.limit = tokenizer, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.good = np.zeros(1 << 14, bool)

    def add(self, words: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch([MARK + w for w in words], add_special_tokens=False)]
        decoded = self.tokenizer.decode_batch(encoded, skip_special_tokens=False)
        n, used = len(self.index), int(self.ends[len(self.index) - 1]) if self.index else 0
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = used + int(sizes.sum())
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.good = np.concatenate([self.good, np.zeros_like(self.good)])
        self.ids[used:total] = np.fromiter(chain.from_iterable(encoded), np.int32, total - used)
        self.ends[n:n + len(words)] = used + np.cumsum(sizes)
        self.good[n:n + len(words)] = [w.replace(MARK, " ") == d for w, d in zip(words, decoded)]
        self.index.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of each text's ids, all ids, and whether each text decodes to itself."""
        words = [split_words(t) for t in texts]
        if len(self.index) > self.limit:
            self.clear()
        fresh = [w for w in set(chain.from_iterable(words)) if w not in self.index]
        if fresh:
            self.add(fresh)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        starts = np.where(at > 0, self.ends[at - 1], 0)
        sizes = self.ends[at] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        edges = np.concatenate([[0], np.cumsum(counts)])
        bad = np.concatenate([[0], np.cumsum(~self.good[at])])
        return ends[edges], ids, bad[edges[1:]] == bad[edges[:-1]]


def split_words(text: str) -> list[str]:
    """The words of a text, without the marker that each begins with; further markers stay."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]


@lru_cache(maxsize=1)
def worker(data: bytes) -> tuple[Model, object, Words | None]:
    """The rebuilt tokenizer of a worker process, with a table of words where words are independent."""
    rules = parse(data)
    rebuilt = build(rules)
    plain = rules.dummy_prefix and rules.escape_blanks and not rules.strip_blanks and not rules.charsmap
    return rules, rebuilt, Words(build(rules)) if plain and rebuilt.pre_tokenizer is not None else None


def encode_texts(data: bytes, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, ids, and whether each text's ids decode to its normalised form."""
    rules, rebuilt, words = worker(data)
    if words is not None:
        return words.encode(texts)
    ids = [e.ids for e in rebuilt.encode_batch(texts, add_special_tokens=False)]
    decoded = rebuilt.decode_batch(ids, skip_special_tokens=False)
    good = [_plain(rules, rebuilt.normalizer.normalize_str(t)) == d for t, d in zip(texts, decoded)]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    return offsets, np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])), np.array(good, bool)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | bytes = MODEL, threads: int = THREADS,
           check_rows: bool = False) -> DataFrame:
    """Token ids of every whole text, decoded again in the same pass.

    Returns ``key``, n_tokens, ids, round_trip (the ids decode to the normalised text).
    ``check_rows`` compares every row with the sentencepiece library and fails on a difference.
    The model travels to the executors by value (its size is that of one vocabulary file, checked).
    Null text: null n_tokens, ids and round_trip. Empty text: no ids, true. Repeated rows: each is
    encoded. Empty table: no rows. Other columns are not read.
    """
    data = read_model(model) if isinstance(model, str) else model
    if len(data) > 64 << 20:
        raise ValueError("the model file is larger than 64 MB")
    verify(build(parse(data)), data)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *OUT.fields])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        reference = None
        if check_rows:
            import sentencepiece

            reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            at = 0
            while at < len(texts):  # parts of bounded size, so that long texts don't meet in one call
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < BATCH_CHARS):
                    chars += int(sizes[end])
                    end += 1
                part = texts.slice(at, end - at).to_pylist()
                offsets, ids, good = encode_texts(data, [t or "" for t in part])
                if reference is not None:
                    for i, t in enumerate(part):
                        if t is not None and ids[offsets[i]:offsets[i + 1]].tolist() != reference.encode(t):
                            raise ValueError("a row's ids differ from the sentencepiece library's")
                null = np.array([t is None for t in part], bool)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([
                    keys.slice(at, end - at), pa.array(np.diff(offsets).astype(np.int32), mask=null), lists,
                    pa.array(good, mask=null)], names=schema.names)
                at = end

    return docs.select(key, text).mapInArrow(run, schema)


def _plain(model: Model, normal: str) -> str:
    """The normalised text as decoding gives it back."""
    text = normal.replace(MARK, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str | bytes = MODEL) -> DataFrame:
    """Texts of token ids: ``key`` and text. Null ids: null text."""
    data = read_model(model) if isinstance(model, str) else model
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        _, rebuilt, _ = worker(data)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = rebuilt.decode_batch([i or [] for i in lists], skip_special_tokens=False)
            yield pa.RecordBatch.from_pydict({
                key: batch.column(0), "text": pa.array([None if i is None else t for i, t in zip(lists, texts)], pa.string())})

    return rows.select(key, ids).mapInArrow(run, schema)
