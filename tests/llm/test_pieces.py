import struct

import pytest
import sentencepiece
from helpers import documents, odd

from warywire.llm import pieces
from warywire.llm.common import table


def field(number, wire, value):
    def varint(n):
        out = b""
        while True:
            out, n = out + bytes([n & 0x7F | (0x80 if n > 0x7F else 0)]), n >> 7
            if not n:
                return out

    if wire == 0:
        return varint(number << 3) + varint(value)
    if wire == 5:
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(byte_fallback):
    """A small unigram model, written field by field."""
    known = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        known += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "a", "b", "c", "d", "e", "▁ab", "abc", "cd", "▁a", "bcd", "de", "▁c", "ed", "ab"]
    known += [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    body = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, s) + field(3, 0, k)) for t, s, k in known)
    trainer = field(3, 0, 1) + field(35, 0, int(byte_fallback)) + field(40, 0, 0)
    normaliser = field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1)
    return body + field(2, 2, trainer) + field(3, 2, normaliser)


def test_every_document_as_the_library_does(spark, sf):
    docs = table(spark, sf, "documents")
    reference = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.encode(docs, check_rows=True).collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert all(r.ids == reference.encode(texts[r.doc_id]) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == texts


def test_blanks_markers_and_rare_characters(spark):
    texts = list(pieces.PROBES) + ["  a", "a  ", " ", "   ", "▁▁a ▁", "\n\n a\tb", "é" * 9, "\U0001f600 x"]
    rows = pieces.encode(documents(spark, *enumerate(texts)), check_rows=True).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows if "▁" not in texts[r.doc_id])


def test_edges(spark):
    rows = pieces.encode(odd(documents(spark, (1, None), (2, ""), (3, "x" * 200_000), (None, "a"), (None, "a")))).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].ids is None and by[1].n_tokens is None and by[1].round_trip is None
    assert by[2].ids == [] and by[2].round_trip and by[3].round_trip and len(rows) == 5
    assert pieces.encode(documents(spark, (1, "a")).filter("false")).count() == 0
    assert pieces.decode(pieces.encode(documents(spark, (1, None)))).collect()[0].text is None


def test_a_full_table_of_words_starts_anew(spark):
    words = pieces.Words(pieces.build(pieces.parse(pieces.read_model())), limit=5)
    reference = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for n in range(6):
        texts = [f"some {n} words {k}" for k in range(4)]
        offsets, ids, good = words.encode(texts)
        assert [ids[offsets[i]:offsets[i + 1]].tolist() for i in range(4)] == [reference.encode(t) for t in texts]
        assert good.all()


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_scores_and_byte_fallback(spark, fallback):
    data = unigram_model(fallback)
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    rules = pieces.parse(data)
    assert rules.kind == pieces.UNIGRAM and rules.byte_fallback == fallback
    texts = ["abcd ab", "edcba cded", "a b c d e", "abcdeabcde"] + (["aé b", "☃"] if fallback else [])
    rebuilt = pieces.build(rules)
    assert [rebuilt.encode(t, add_special_tokens=False).ids for t in texts] == [reference.encode(t) for t in texts]


def test_a_wrong_model_is_refused(spark):
    with pytest.raises(ValueError):
        pieces.parse(b"")
    data = pieces.read_model()
    with pytest.raises(ValueError):
        pieces.verify(pieces.build(pieces.parse(unigram_model(True))), data)
