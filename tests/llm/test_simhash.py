import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import xxhash
from helpers import DOCS, documents, odd
from pyspark.sql import functions as F

from warywire.llm import simhash
from warywire.llm.common import table
from warywire.llm.components import components


def plain_print(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """Smallest id reachable, comparing all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_documents_against_all_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    prints = {r.doc_id: plain_print(r.text) for r in docs.collect()}
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints, 2)


def near_prints(n, flips, seed=1):
    draw = random.Random(seed)
    out = []
    for c in range(4):
        centre = draw.getrandbits(64)
        for _ in range(n // 4):
            v = centre
            for b in draw.sample(range(64), draw.randint(0, flips)):
                v ^= 1 << b
            out.append(v)
    return dict(enumerate(out))


def classes(spark, prints, masks, radius, **kw):
    rows = spark.createDataFrame([(i, [simhash.signed(v)]) for i, v in prints.items()], "id long, fp array<long>")
    distinct = rows.groupBy("fp").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    found = components(simhash.group_links(distinct, masks, radius, **kw)).collect()
    root = {r.node: r.root for r in found}
    first = {tuple(r.fp): r.id for r in distinct.collect()}
    return {r.id: root.get(first[tuple(r.fp)], first[tuple(r.fp)]) for r in rows.collect()}


def test_large_groups_are_refined_without_losing_links(spark):
    prints = near_prints(600, 5)
    want = plain_components(prints, 2)
    assert classes(spark, prints, simhash.pigeonhole(2), 2, group=8) == want
    assert classes(spark, prints, simhash.pigeonhole(2), 2) == want
    assert classes(spark, near_prints(300, 6, 2), simhash.pigeonhole(3), 3, group=20) == plain_components(near_prints(300, 6, 2), 3)


def test_tree_of_gray_order_finds_every_link():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.concatenate([b ^ (np.uint64(1) << draw.integers(0, 64, 60, dtype=np.uint64)) for b in base])
    codes = codes[np.argsort(simhash.gray_rank(codes), kind="stable")]
    found = simhash.linked(codes, lambda i, j: np.ones(len(i), bool), 2)
    want = plain_components({i: int(v) for i, v in enumerate(codes)}, 2)
    assert found.tolist() == [want[i] for i in range(len(codes))]


def test_gray_rank_orders_single_bit_steps():
    rank = np.arange(256, dtype=np.uint64)
    codes = rank ^ (rank >> np.uint64(1))
    assert (simhash.gray_rank(codes) == rank).all()


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    root = {r.node: r.root for r in components(links).collect()}
    assert {root[i] for i in range(301)} == {0} and root[1001] == 1000 and len(root) == 303


def test_a_star_with_many_leaves(spark):
    links = spark.createDataFrame([(5000, i) for i in range(1, 2000)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {1}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    docs = documents(spark, (4, None), (2, ""), (9, " \n\t"), (5, "one"), (6, "ONE"), (6, "ONE"), (None, "one"), (None, "alone here"))
    rows = simhash.near_duplicates(odd(docs)).collect()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert {(r.doc_id, r.component_id) for r in rows if r.component_id == 5} == {(5, 5), (6, 5), (None, 5)}
    assert [r.component_id for r in rows if r.doc_id is None and r.component_id != 5] == [None] and len(rows) == 8
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints_without_an_id_link_the_others(spark):
    near = {(7, 0b0): 7, (None, 0b11): 7, (9, 0b1111): 7, (None, 0b111111): 7, (3, 0xFF << 40): 3, (None, 0xFF << 20): None, (None, 0x3FF << 20): None}
    rows = spark.createDataFrame([(i, [v]) for i, v in near], "id long, fp array<long>")
    found = simhash.classes(rows, simhash.pigeonhole(2), 2).collect()
    assert {(r.id, r.fp[0]): r["class"] for r in found} == near


def words_of(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def test_one_document_of_each_group_stays(spark):
    draw = random.Random(8)
    rows, group = [], {}
    for g in range(40):
        text = words_of(draw, 150)
        for c in range(5):
            copy = list(text)
            for _ in range(c % 3):
                copy[draw.randrange(150)] = "changed"
            i = draw.randrange(10**6)
            rows.append((i, " ".join(copy)))
            group[i] = g
    singles = [(10**7 + i, " ".join(words_of(draw, 120))) for i in range(200)]
    docs = odd(documents(spark, *rows, *singles))
    kept = simhash.one_of_each(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert {i for i, _ in singles} <= ids
    by = defaultdict(list)
    for i in ids & set(group):
        by[group[i]].append(i)
    assert len(by) == 40 and sum(len(v) == 1 for v in by.values()) >= 38
    assert all(min(i for i in group if group[i] == g) in v for g, v in by.items())


def test_one_of_equal_rows_stays(spark):
    docs = documents(spark, (1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, "z " * 100_000))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 2, 4]
    assert simhash.one_of_each(docs.filter("false")).count() == 0


def shingled(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    x, y = shingled(a), shingled(b)
    return len(x & y) / len(x | y)


def pairs_at(draw, similarity, n, words=400):
    """Pairs of texts whose exact five-word similarity is as near to the given one as single changed words allow."""
    out = []
    for _ in range(n):
        a = words_of(draw, words)
        b, places = list(a), draw.sample(range(words), words)
        best = (1.0, list(b))
        for at in places:
            b[at] = f"x{draw.randrange(10**6)}"
            s = jaccard(" ".join(a), " ".join(b))
            if abs(s - similarity) <= abs(best[0] - similarity):
                best = (s, list(b))
            if s < similarity - 0.03:
                break
        out.append((" ".join(a), " ".join(best[1]), best[0]))
    return out


def test_recall_from_the_bound_on_and_nothing_below(spark):
    draw = random.Random(31)
    rows, kind = [], {}
    for k, similarity in enumerate((0.75, 0.79, 0.805, 0.85)):
        for i, (a, b, exact) in enumerate(pairs_at(draw, similarity, 120)):
            at = 10_000 * k + 2 * i
            rows += [(at, a), (at + 1, b)]
            kind[at + 1] = exact
    kept = {r.doc_id for r in simhash.one_of_each(documents(spark, *rows)).collect()}
    assert all(i in kept for i, _ in rows if i % 2 == 0)
    above, below = [i for i, s in kind.items() if s >= 0.8], [i for i, s in kind.items() if s < 0.8]
    assert len(above) > 200 and sum(i not in kept for i in above) >= 0.95 * len(above)
    assert len(below) > 200 and all(i in kept for i in below)


def test_masks_follow_the_table_and_the_chance_of_a_miss():
    assert [m.bit_count() for _, m in simhash.masks_for(1 << 18, 0.8)][:2] == [16, 16]
    assert simhash.tables_for(20, 0.8) > simhash.tables_for(16, 0.8) > simhash.tables_for(12, 0.8)
    assert {w for w, _ in simhash.masks_for(1000, 0.8)} == {0, 1, 2, 3}


def test_nearest_pairs_of_a_large_group_in_bounded_memory():
    draw = np.random.default_rng(3)
    fp = draw.integers(0, 1 << 60, (1, 4), dtype=np.uint64) ^ (np.uint64(1) << draw.integers(0, 60, (simhash.PART, 4), dtype=np.uint64))
    some = np.stack(np.triu_indices(60, 1))
    some[:, ::2] = some[::-1, ::2]  # either place first
    want = set()
    for i in range(60):
        far = sorted((int(np.bitwise_count(fp[i] ^ fp[j]).sum()), j) for j in range(60) if j != i)
        want |= {(min(i, j), max(i, j)) for _, j in far[:4]}
    assert list(map(tuple, simhash.closest(some, fp, 4).T.tolist())) == sorted(want)
    assert simhash.closest(some[:, :0], fp, 4).shape == (2, 0)
    every = np.stack(np.triu_indices(simhash.PART, 1))
    tracemalloc.start()
    simhash.closest(every, fp, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20  # all words of all pairs at once took 320 MB


def test_a_large_group_of_near_copies_in_parts(spark, monkeypatch):
    draw = random.Random(6)
    text = words_of(draw, 200)
    rows = []
    for i in range(600):
        copy = list(text)
        copy[draw.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(simhash.candidates, "__defaults__", (50, simhash.NEAREST))
    assert [r.doc_id for r in simhash.one_of_each(documents(spark, *rows)).collect()] == [0]


def test_a_partner_beyond_the_nearest_is_found(spark, monkeypatch):
    draw = random.Random(12)
    codes = [[simhash.signed(draw.getrandbits(64)) for _ in range(4)]]
    for i in range(1, 30):  # all within a few bits of the first
        codes.append([c ^ (1 << (i + w)) for w, c in enumerate(codes[0])])
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id long, fp array<long>")
    for part in (2048, 8):
        pairs, cuts = simhash.candidates(rows, 0.8, part, 1)
        first = {(r.a, r.b) for r in pairs.collect()}
        assert cuts.count() > 0 and len(first) < 30 * 29 // 2
        # roots: even and odd rows, and one that stands alone
        rooted = rows.withColumn("root", F.when(F.col("id") == 29, F.col("id")).otherwise(F.col("id") % 2))
        root = {i: i if i == 29 else i % 2 for i in range(30)}
        more = {(r.a, r.b) for r in simhash.further(rooted, cuts, 0.8, part).collect()}
        assert more == {(i, j) for i in range(30) for j in range(i) if root[i] != root[j]}


def test_a_chain_through_a_fifth_partner(spark, monkeypatch):
    """Two groups that only one pair links, which is not among the nearest of either side."""
    draw = random.Random(21)
    base = words_of(draw, 300)
    rows = []
    for g in range(2):
        text = list(base)
        for at in range(30 * g, 30 * g + 5 * g):
            text[at] = f"g{at}"
        for i in range(8):
            copy = list(text)
            copy[200 + 7 * i] = f"z{g}{i}"
            rows.append((100 * g + i, " ".join(copy)))
    monkeypatch.setattr(simhash.candidates, "__defaults__", (simhash.PART, 1))
    assert [r.doc_id for r in simhash.one_of_each(documents(spark, *rows)).collect()] == [0]


def tied(pairs, nodes):
    up = {i: i for i in nodes}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def test_a_tree_ties_what_all_pairs_tie_at_any_distance():
    draw = np.random.default_rng(9)
    fp = draw.integers(0, 1 << 60, (1, 4), dtype=np.uint64) ^ (np.uint64(1) << draw.integers(0, 6, (60, 4), dtype=np.uint64))
    every = np.stack(np.triu_indices(60, 1))
    every = every[:, draw.random(every.shape[1]) < 0.2]
    kept = simhash.tree(every, fp)
    assert kept.shape[1] < 60 < every.shape[1] and simhash.tree(every[:, :0], fp).shape == (2, 0)
    for most in range(0, 9):
        near = [p[:, np.bitwise_count(fp[p[0]] ^ fp[p[1]]).sum(axis=1) <= most].T.tolist() for p in (every, kept)]
        assert tied(near[0], range(60)) == tied(near[1], range(60))


def test_pairs_of_a_large_group_are_confirmed_where_they_meet(spark, monkeypatch):
    """Members of one pattern in chains of similar sets: no more links than members, whatever the number of pairs."""
    draw = random.Random(12)
    codes = [[simhash.signed(draw.getrandbits(64)) for _ in range(4)]]
    for i in range(1, 30):  # all within a few bits of the first
        codes.append([c ^ (1 << (i + w)) for w, c in enumerate(codes[0])])
    own = {i: np.unique(np.array([draw.getrandbits(64) for _ in range(100)], np.uint64)) for i in (0, 15)}
    for i in set(range(30)) - {0, 15, 29}:  # each shares 99 of 100 with the one before
        own[i] = np.unique(np.r_[own[i - 1][1:], np.array([draw.getrandbits(64) for _ in range(1)], np.uint64)])
    rows = spark.createDataFrame([(i, c, i, 1000) for i, c in enumerate(codes)], "id long, fp array<long>, root long, size int")
    held = [(i, len(s), bytearray(simhash.signature(s)), bytearray(s.tobytes())) for i, s in own.items()]  # 29 has no set
    sets = spark.createDataFrame(held, "sid long, n int, signature binary, hashes binary")
    alike = {(i, j) for i in own for j in own if j < i and 100 * len(np.intersect1d(own[i], own[j])) >= 80 * len(np.union1d(own[i], own[j]))}
    _, cuts = simhash.candidates(rows.select("id", "fp"), 0.8, 2048, 1)
    for part, size in ((2048, 1 << 24), (8, 1 << 24), (2048, 3000)):
        monkeypatch.setattr(simhash, "HELD", size)
        found = simhash.further(rows, cuts, 0.8, part, lambda named: sets.join(named.withColumnRenamed("id", "sid"), "sid"), 80).collect()
        pairs = {(r.a, r.b) for r in found}
        assert len(pairs) == len(found) and pairs <= alike
        assert tied(pairs, range(30)) == tied(alike, range(30)) and len(set(tied(pairs, range(30)).values())) == 3
        assert part < 2048 or size < 1 << 24 or len(pairs) < len(alike) / 2


def test_a_crowded_pattern_gives_as_many_pairs_as_members(spark):
    draw = random.Random(12)
    codes = [[simhash.signed(draw.getrandbits(64)) for _ in range(4)]]
    for i in range(1, 40):
        codes.append([c ^ (1 << (i + w)) for w, c in enumerate(codes[0])])
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id long, fp array<long>")
    pairs, cuts = simhash.candidates(rows, 0.8)
    assert cuts.count() > 0 and len(set(tied({(r.a, r.b) for r in pairs.collect()}, range(40)).values())) == 1
    assert pairs.count() < 40 * 4  # of 780; the four nearest of each made more
