import random
import re

import numpy as np
import pytest
from helpers import documents, odd

from warywire.llm import jaccard
from warywire.llm.common import table


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Components over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[top(i)] = min(least.get(top(i), ident), ident)
    return sorted(((ident, len(sets[i]), least.get(top(i))) for i, (ident, _) in enumerate(rows)), key=repr)


def result(docs, **settings):
    found = jaccard.jaccard_components(docs, **settings)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def near_copies(seed, n, words=60):
    """Texts from a few templates with some words changed: similarities on both sides of the bound."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    shared = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        template = random.Random(draw.randrange(6))
        text = ["".join(template.choices("mnopqrs", k=4)) for _ in range(words)]
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5])):
            text[draw.randrange(len(text))] = word()
        if draw.random() < 0.3:
            text += shared
        out.append(" ".join(text[:draw.choice([words, words, words - 5, 7, 3])] if draw.random() < 0.4 else text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_all_pairs(spark, seed):
    rows = list(enumerate(near_copies(seed, 260)))
    random.Random(seed).shuffle(rows)
    want = brute(rows)
    assert result(documents(spark, *rows)) == want
    assert len({r[2] for r in want}) < len(rows)
    # small blocks, ranges and tiles, and a smaller part of the hash space counted first
    assert result(documents(spark, *rows).repartition(5), block=3000, size=2000, tile=8, share=1 / 8) == want


def test_every_document(spark, sf):
    docs = table(spark, sf, "documents")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_reach_beyond_the_bound(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):  # each differs from the last by one more word: neighbours link, the ends don't
        text = list(words)
        for i in range(k):
            text[8 * i + 4] = f"x{i}"
        rows.append((100 - k, " ".join(text)))
    found = result(documents(spark, *rows))
    assert found == brute(rows) and {r[2] for r in found} == {89}


def test_edges(spark):
    text = "One two three four five six seven eight nine ten"
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, text), (7, text), (None, text),
            (8, text.lower()), (9, text + " eleven"), (10, long), (11, long + " more"), (None, "alone here"), (None, None), (12, "é\xa0x y"),
            (13, "É\xa0x y"), (14, "same " * 50), (15, "same " * 70)]
    assert result(odd(documents(spark, *rows))) == brute(rows)
    assert result(documents(spark, (1, "a")).filter("false")) == []


def test_bit_counts_never_rule_out_a_link():
    draw = np.random.default_rng(2)
    for n in (1, 3, 10, 100, 5000):
        x = np.unique(draw.integers(0, 1 << 63, n, np.uint64))
        y = np.unique(np.concatenate([x[:int(0.9 * n)], draw.integers(0, 1 << 63, max(1, n // 20), np.uint64)]))
        both = len(np.intersect1d(x, y))
        if jaccard.enough(both, len(x), len(y), 80):
            assert jaccard.possible(len(x), len(y), jaccard.signature(x), jaccard.signature(y), 80)
    far = np.unique(draw.integers(0, 1 << 63, 200, np.uint64))
    other = np.unique(draw.integers(0, 1 << 63, 200, np.uint64))
    assert not jaccard.possible(200, 200, jaccard.signature(far), jaccard.signature(other), 80)


def test_a_large_group_of_near_copies(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(700):
        text = list(words)
        for _ in range(2):
            text[draw.randrange(80)] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    assert result(documents(spark, *rows)) == brute(rows)
