import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import sentencepiece
from helpers import documents, odd
from tokenizers import Tokenizer

from warywire.llm import align, pieces
from warywire.llm.common import table

A = Tokenizer.from_file(align.BYTES)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
ALPHABET = align.byte_alphabet()
BYTES_A = {i: bytes(ALPHABET[c] for c in t) for t, i in A.get_vocab(with_added_tokens=False).items()}


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute(texts):
    """Row by row over whole texts, all links one by one."""
    rows, docs = [], Counter()
    for text in texts:
        a, b = ([], []) if not text else (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text))
        x, y = [BYTES_A[i] for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            rows.append(None)
            continue
        ends = [set(), set()]
        for parts, out in ((x, ends[0]), (y, ends[1])):
            at = 0
            for part in parts:
                at += len(part)
                out.add(at)
        group_a, group_b = defaultdict(list), defaultdict(list)
        common = sorted(ends[0] & ends[1])
        for ids, parts, out in ((a, x, group_a), (b, y, group_b)):
            at = k = 0
            for i, part in zip(ids, parts):
                at += len(part)
                out[k].append(i)
                if at == common[k]:
                    k += 1
        links = [(i, j) for k in range(len(common)) for i in group_a[k] for j in group_b[k]]
        said = ";".join(f"{','.join(map(str, group_a[k]))}|{','.join(map(str, group_b[k]))}" for k in range(len(common)))
        rows.append((len(a), len(b), len(common), links, said))
        docs.update(set(links))
    best = Counter()
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n, links, said = row
        out.append((n_a, n_b, n, len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links),
                    sha256(said.encode()).hexdigest()))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(found):
    return {r.doc_id: tuple(r[c] for c in NAMES) for r in found.collect()}


def test_every_document_as_link_by_link(spark, sf):
    docs = table(spark, sf, "documents")
    known = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip([k for k, _ in known], brute([t for _, t in known])))
    assert rows_of(align.alignment(docs)) == want
    # small blocks and several slices of the counts change nothing
    assert rows_of(align.alignment(docs, slice_rows=3000, chars=20_000)) == want


def test_blanks_and_odd_characters(spark):
    draw = random.Random(3)
    parts = ["a", "the", "foo", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "é", "数学", "\U0001f642", "'s", "'", "don't", ".", "123",
             "<|endoftext|>", "<s>", "<0x41>", "_", ",", ";:", "½,", "\x1c", "\x85", "\x0b", "İ", "▁", "-", "A"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(400)] + list(pieces.PROBES)
    texts = [t for t in texts if "\x00" not in t]
    found = rows_of(align.alignment(documents(spark, *enumerate(texts))))
    for i, row in enumerate(brute(texts)):
        assert found[i] == row, texts[i]


def test_edges(spark):
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    texts = [None, "", "a", "a", "▁", long, "x" * 100_000, "\x01\x02" * 3000]
    found = align.alignment(odd(documents(spark, *enumerate(texts), (None, "a"), (3, "a"))))
    rows = found.collect()
    assert len(rows) == 10 and found.columns == ["doc_id", *NAMES]
    want = brute([*texts, "a", "a"])
    assert sorted(tuple(r[c] for c in NAMES) for r in rows) == sorted(want)
    assert align.alignment(documents(spark, (1, "a")).filter("false")).count() == 0


def test_groups_of_token_lengths():
    assert align.align([1, 2, 3], [3, 3]) == [(2, 1), (3, 2)]
    assert align.align([], []) == []
    assert align.align([4], [1, 1, 2]) == [(1, 3)]


def test_a_long_group_counts_all_its_links():
    pair = align.Pair(open(align.BYTES).read(), pieces.read_model())
    pair.bytes_b = {5: b"a", 6: b"bab"}
    b = [5] + [6, 5] * 6 + [6]
    text = b"".join(pair.bytes_b[i] for i in b)
    pair.bytes_a = {1: text[:-1], 2: text[-1:]}
    pair.whole, pair.spans_a, pair.spans_b = False, [0, len(text) - 1, 1], [0] * 5 + [1, 3]
    pair.enter(text, [1, 2], b)
    assert list(pair.numbers) == [2, len(b), 1, 2 * len(b), 1]


@pytest.mark.parametrize("long", [3, 30])
def test_links_add_up(long):
    pair = align.Pair(open(align.BYTES).read(), pieces.read_model())
    pair.bytes_a, pair.bytes_b = {1: b"ab", 2: b"a"}, {5: b"a", 6: b"ba"}
    pair.whole, pair.spans_a, pair.spans_b = False, [0, 2, 1], [0] * 5 + [1, 2]
    pair.enter(b"ab" * long + b"a", [1] * long + [2], [5] + [6] * long)
    n = long + 1
    assert pair.numbers[3] == sum(pair.times) == n * n
