import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
from helpers import documents, odd

from warywire.llm import queries, resample

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def runs_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, target):
    hashed = [[zlib.crc32(f.encode()) % 10000 for f in runs_of(t)[1]] for _, t in rows]
    s = Counter(b for h in hashed for b in h)
    t = Counter(zlib.crc32(f.encode()) % 10000 for x in target for f in runs_of(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for (ident, text), h in zip(rows, hashed):
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in h]
        weight = sum(gains) // len(gains) if gains else 0
        score = None
        if ident is not None:
            draw = int(sha256(f"7:{ident}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((draw + 0.5) / 2**32)))
        out.append([ident, len(h), weight, score, None, len(runs_of(text)[0])])
    able = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(able[:len(able) * 25 // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts(n, seed=4):
    draw = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "d1", "é", "straße", "数学", "ÀB", "x" * 40, "7", "the", "of", "\U0001f642"]
    marks = [" ", ", ", "\n", "--", "\x00", "_", "\x7f", "  "]
    return ["".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_as_feature_by_feature(spark):
    rows = [*enumerate(texts(300)), (300, None), (301, ""), (302, "word " * 70_000), (303, "y" * 50_000), (None, "one two " * 20)]
    target = texts(20, 9)
    found = resample.resample(odd(documents(spark, *rows)), documents(spark, *enumerate(target)))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, target)


def test_repeated_rows_ties_and_empty_tables(spark):
    rows = [(i % 7, "same words here " * 10) for i in range(40)]
    found = resample.resample(documents(spark, *rows), documents(spark, (0, "words")))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, ["words"])
    none = documents(spark, (1, "a")).filter("false")
    assert resample.resample(none, documents(spark, (0, "words"))).count() == 0
    rows = list(enumerate(texts(20)))
    assert sorted((tuple(r) for r in resample.resample(documents(spark, *rows), none).collect()), key=repr) == brute(rows, [])


def test_composed_crcs():
    tables = resample.appenders()
    for a, b in ((b"", b"x"), (b"abc ", b"d" * 1000), ("é".encode(), bytes(range(256)) * 300)):
        got = resample.composed(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]), tables)
        assert int(got[0]) == zlib.crc32(a + b)


def test_longer_runs_and_a_growing_dictionary():
    known = resample.Dictionary(limit=3)
    for seed in range(5):
        some = [t.encode() for t in texts(20, seed)]
        sizes, found = known.features(some, 10000, 3)
        want = []
        for t in some:
            w = runs_of(t.decode())[0]
            for n in (1, 2, 3):
                want += [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for i in range(len(w) - n + 1)]
        assert found.tolist() == want
        known.build()


def test_scan_finds_unknown_words_between_known_ones():
    known = resample.Dictionary()
    known.scan(b"a bc a")
    known.build()
    assert known.scan(b"a  abc bc a b").tolist() == [0, 2, 1, 0, 3]


def test_twin(spark, sf):
    from oracle import compare, connect

    name = "op11_word_automaton"
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.SQL[name], sf) is None
