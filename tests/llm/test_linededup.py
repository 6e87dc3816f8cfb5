import hashlib
import random

import oracle
from helpers import DOCS, documents, odd

from warywire.llm import linededup
from warywire.llm.queries import op10_line_chunks

PASSAGE = " ".join(f"w{i}" for i in range(60))


def test_against_sql(spark, sf):
    assert oracle.compare(spark, oracle.connect(sf), op10_line_chunks, linededup.SQL, sf) is None


def texts(spark, *rows):
    return {r.doc_id: r.text for r in linededup.line_dedup(documents(spark, *rows)).collect()}


def test_a_repeated_passage_stays_once_and_other_lines_stay(spark):
    out = texts(spark, (3, f"own line c\n{PASSAGE}\nlast c"), (1, f"own line a\n{PASSAGE}"), (2, f"{PASSAGE}\nown line b"))
    assert out == {1: f"own line a\n{PASSAGE}", 2: "own line b", 3: "own line c\nlast c"}


def test_short_common_lines_stay(spark):
    rows = [(i, f"a common line\nown words {i}") for i in range(20)]
    assert texts(spark, *rows) == dict(rows)


def cut(lines, every=linededup.EVERY):
    """Chunk ends of short lines by the rolling hash."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in lines]
    return [i for i in range(len(h)) if (h[i] ^ ((h[i - 1] if i else 0) << 1)) % every == 0 or i == len(h) - 1]


def test_boundaries_move_with_the_lines(spark):
    shared = [f"line {i} of the shared block" for i in range(60)]
    ends = cut(shared)
    a, b = "\n".join(["first", *shared]), "\n".join(["other beginning", "and more", *shared, "an end"])
    out = texts(spark, (1, a), (2, b))
    inner = [e - s for s, e in zip(ends, ends[1:])]
    kept = out[2].split("\n")
    assert out[1] == a and kept[:2] == ["other beginning", "and more"] and kept[-1] == "an end"
    lone = sum(1 for n in inner if n == 1)  # a chunk of one short line stays
    assert len(kept) <= 3 + lone + (ends[0] + 1) + (len(shared) - ends[-2])


def test_copies_become_empty_and_the_first_stays(spark):
    text = f"x\n{PASSAGE}\n{PASSAGE} more"
    out = linededup.line_dedup(documents(spark, (5, text), (5, text), (None, text))).collect()
    assert sorted(len(r.text) for r in out if r.doc_id == 5)[-1] == len(text)
    assert sum(r.removed_words for r in out) == 2 * (60 + 61)


def test_edges(spark):
    out = linededup.line_dedup(odd(documents(spark, (1, None), (2, ""), (3, "\n\n"), (4, "\n\n"), (None, "a")))).collect()
    by = {r.doc_id: r for r in out}
    assert by[1].text is None and by[2].text == "" and by[None].text == "a" and len(out) == 5
    assert linededup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0
    assert texts(spark, (1, "a\n" * 20_000 + PASSAGE), (2, PASSAGE))[2] == ""


def test_documents_keep_their_columns(spark):
    docs = odd(documents(spark, (1, f"a\n{PASSAGE}"), (2, f"b\n{PASSAGE}"), (3, None)))
    out = {r.doc_id: r for r in linededup.deduped_documents(docs).collect()}
    assert out[2].text == "b" and out[2].n_chars == 1 and out[1].n_chars == 2 + len(PASSAGE) and out[3].n_chars is None
    assert linededup.deduped_documents(docs).columns == docs.columns


def whole(spark, *rows):
    return {r.doc_id: r.text for r in linededup.deduped_documents(documents(spark, *rows)).collect()}


def few_words(draw, n):
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))


def test_passages_of_few_lines_go_wherever_chunks_end(spark):
    draw = random.Random(4)
    rows, want = [], {}
    for case in range(105):
        n, words = 2 + case % 7, draw.randint(60, 100)
        cuts = sorted(draw.sample(range(1, words), n - 1)) if case % 2 else [words * k // n for k in range(1, n)]
        shared = [few_words(draw, b - a) for a, b in zip([0, *cuts], [*cuts, words])]
        for copy in (0, 1):
            before, after = ([few_words(draw, 12) for _ in range(3)] for _ in range(2))
            i = 1000 * copy + case
            rows.append((i, "\n".join([*before, *shared, *after])))
            want[i] = "\n".join([*before, *after]) if copy else rows[-1][1]
    assert whole(spark, *rows) == want


def test_runs_with_blank_lines_and_runs_of_one_line(spark):
    draw = random.Random(5)
    shared = [few_words(draw, 20) for _ in range(4)]
    short = [few_words(draw, 8) for _ in range(4)]
    a = "\n".join(["own a", *shared, "end a", *short])
    b = "\n".join(["own b", shared[0], "", shared[1], " ", *shared[2:], "end b", *short[:3]])
    same = "\n".join(["one line that comes again and again"] * 100)
    rows = [(1, a), (2, b), (3, same), (4, None), (5, "\n\n")]
    out = whole(spark, *rows)
    assert out[1] == a and out[4] is None and out[2].startswith("own b\nend b\n" + short[0])
    left = out[3].split("\n")
    assert 1 <= len(left) < 100 and set(left) == set(same.split("\n"))


def test_very_long_documents(spark):
    draw = random.Random(9)
    lines = [few_words(draw, 6) for _ in range(100_000)]
    a, b = "\n".join(lines), "\n".join(["own line", *lines[:50_000], "between", *lines[50_000:]])
    out = whole(spark, (1, a), (2, b))
    assert out[1] == a and out[2] == "own line\nbetween"
    out = texts(spark, (1, a), (2, b))
    assert out[1] == a and len(out[2]) < len(b) // 3
