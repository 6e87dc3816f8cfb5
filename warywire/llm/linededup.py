"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of a line and the one before it decides where a chunk of lines ends, so
boundaries move with the content and not with its place in a document. A line as long as a passage is a
chunk of its own. Chunks of several lines or of a passage's length that occur more than once in the
whole table are removed from all places but the first, after their bytes have been compared.

Chunks alone miss most passages of few lines: no chunk end need fall on the passage's first and last
line. ``cut_passages`` therefore also takes, from every line on and up to every line, the shortest run
of lines that has a passage's length. A passage repeated anywhere is the union of such runs, each
repeated with it, so all its lines are found wherever chunks end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import word_count

EVERY = 4
PASSAGE = 50
RUN = "run "  # before the keys of runs, which are compared without the lines that have no words


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def cut_chunks(docs: DataFrame, every: int = EVERY, passage: int = PASSAGE) -> DataFrame:
    """Adds ``chunk`` to (rid, doc_id, text), one row for each chunk that may be removed: its place, first
    line, number of lines and words, and the md5 of its bytes."""
    whole = docs.select("rid", "doc_id", F.split("text", "\n", -1).alias("lines"))
    hashed = whole.select("*", F.transform("lines", line_hash).alias("h"), F.transform("lines", word_count).alias("words"))

    def ends(i: Column) -> Column:
        rolling = F.get("h", i).bitwiseXOR(F.shiftleft(F.coalesce(F.get("h", i - 1), F.lit(0).cast("long")), 1))
        return (
            (i == F.size("lines") - 1) | (rolling % every == 0)
            | (F.get("words", i) >= passage) | (F.coalesce(F.get("words", i + 1), F.lit(0)) >= passage))

    marked = hashed.filter(F.col("lines").isNotNull()).select(
        "*", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), ends).alias("ends"))

    def chunk(end: Column, k: Column) -> Column:
        start = F.coalesce(F.get("ends", k - 1) + 1, F.lit(0))
        size = end - start + 1
        return F.struct(
            k.alias("k"), start.alias("start"), size.alias("lines"),
            F.aggregate(F.slice("words", start + 1, size), F.lit(0).cast("long"), lambda a, x: a + x).alias("words"),
            F.md5(F.array_join(F.slice("lines", start + 1, size), "\n")).alias("key"))

    found = marked.select("rid", "doc_id", F.transform("ends", chunk).alias("chunks"))
    able = F.filter("chunks", lambda c: (c["lines"] >= 2) | (c["words"] >= passage))
    return found.select("rid", "doc_id", F.explode(able).alias("chunk")).select("rid", "doc_id", "chunk.*")


def cut_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """The shortest runs of lines with ``passage`` words that start, or end, at each line of (rid, doc_id,
    text), in the columns of ``cut_chunks``.

    Lines without words are passed over, so a run has at most ``passage`` lines with words. One line of
    a passage's length is a chunk already and left out.
    """
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("i"), word_count(x).alias("words"), F.md5(x).alias("key"))), lambda x: x["words"] > 0)
    full = docs.select("rid", "doc_id", lines.alias("lines")).filter(F.size("lines") >= 2)
    full = full.select("rid", "doc_id", F.col("lines.i").alias("i"), F.col("lines.words").alias("words"),
                       F.col("lines.key").alias("keys"), F.size("lines").alias("n"))
    full = full.withColumn("back", F.reverse("words"))
    base = passage + 1  # a run is its first line * base + its number of lines; a sum of words likewise

    def run(words: str, at: Column) -> Column:
        """Words * base + lines of the shortest run from ``at`` on, or of all that follows."""
        return F.aggregate(F.slice(words, at + 1, passage), F.lit(0).cast("long"),
                           lambda a, w: F.when(a < passage * base, a + w * base + 1).otherwise(a))

    def enough(a: Column, first: Column) -> Column:
        return F.when((a >= passage * base) & (a % base >= 2), first.cast("long") * base + a % base)

    every = F.when(F.col("n") >= 2, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    onward = F.transform(F.transform(every, lambda i: run("words", i)), lambda a, i: enough(a, i))
    upto = F.transform(F.transform(every, lambda i: run("back", i)), lambda a, i: enough(a, F.col("n") - i - a % base))
    runs = F.filter(F.array_union(onward, upto), lambda r: r.isNotNull())

    def told(r: Column) -> Column:
        at, size = F.floor(r / base).cast("int"), (r % base).cast("int")
        start = F.get("i", at)
        return F.struct(
            at.alias("k"), start.alias("start"), (F.get("i", at + size - 1) - start + 1).alias("lines"),
            F.aggregate(F.slice("words", at + 1, size), F.lit(0).cast("long"), lambda a, x: a + x).alias("words"),
            F.md5(F.array_join(F.slice("keys", at + 1, size), ",")).alias("key"))

    # told per document, so that no row carries the document's arrays along with each of its runs
    found = full.select("rid", "doc_id", runs.alias("runs"), "i", "words", "keys").select("rid", "doc_id", F.transform("runs", told).alias("runs"))
    # outer: else Spark computes the runs once more in a filter for empty arrays
    return found.select("rid", "doc_id", F.explode_outer("runs").alias("run")).filter("run is not null").select("rid", "doc_id", "run.*")


def repeats(docs: DataFrame, every: int = EVERY, passage: int = PASSAGE, whole: bool = False) -> DataFrame:
    """Per row (rid) the chunks to remove: arrays of (start, lines, words). Rows without any are absent.

    With ``whole`` also the runs of ``cut_passages``; these overlap each other and the chunks. A run that
    overlaps the first place of its own lines is not removed.
    """
    chunks = cut_chunks(docs, every, passage)
    if whole:
        runs = cut_passages(docs, passage).withColumn("key", F.concat(F.lit(RUN), "key"))
        chunks = chunks.unionByName(runs)
    chunks = materialize(chunks, "line-chunks")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "start", "lines")
    repeated = chunks.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter(F.col("n") > 1)
    repeated = materialize(repeated.select(
        "key", F.col("first.rid").alias("first_rid"), (F.col("first.start") + F.col("first.lines")).alias("first_end")), "line-repeats")
    spots = chunks.join(repeated, "key").withColumn("first", (F.col("rid") == F.col("first_rid")) & (F.col("start") < F.col("first_end")))
    spots = materialize(
        spots.groupBy("rid").agg(F.collect_list(F.struct("start", "lines", "words", "key", "first")).alias("spots")), "line-spots")
    # Bytes under one key are compared; a key that stands for different bytes removes nothing.
    def bytes_of(lines: Column) -> Column:
        def part(s: Column) -> Column:
            own = F.slice(lines, s["start"] + 1, s["lines"])
            if whole:
                own = F.when(s["key"].startswith(RUN), F.filter(own, lambda x: word_count(x) > 0)).otherwise(own)
            return F.struct(s["key"].alias("key"), F.array_join(own, "\n").alias("bytes"))
        return F.transform("spots", part)

    texts = docs.select("rid", "text").join(spots, "rid").select(F.explode_outer(_bound(F.split("text", "\n", -1), bytes_of)).alias("s")).select("s.*")
    unequal = texts.groupBy("key").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).filter("low <> high").select("key")
    unequal = materialize(unequal, "line-unequal")
    removed = spots.select("rid", F.explode("spots").alias("s")).filter("not s.first").select("rid", "s.*")
    if unequal.limit(1).count():
        removed = removed.join(unequal, "key", "left_anti")
    return removed.groupBy("rid").agg(F.collect_list(F.struct("start", "lines", "words")).alias("cuts"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often lambdas inside ``use`` read it."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, cuts: Column) -> Column:
    """The text without the lines of the cuts; a line stays unless some cut covers it."""
    def rest(lines: Column) -> Column:
        gone = F.flatten(F.transform(cuts, lambda c: F.sequence(c["start"], c["start"] + c["lines"] - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.when(F.size(cuts) > 0, _bound(F.split(text, "\n", -1), rest)).otherwise(text)


def _cut(docs: DataFrame, every: int, passage: int, whole: bool = False) -> DataFrame:
    """(row, text, cuts): every row of ``docs`` as a struct, its text without repeats, and what was cut."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid"))
    rows = materialize(rows, "line-rows")  # numbered once: both sides of the join below read the same numbers
    known = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    joined = rows.join(repeats(known, every, passage, whole), "rid", "left")
    return joined.select("row", "cuts", _without(F.col("row.text"), F.col("cuts")).alias("text"))


def line_dedup(docs: DataFrame, every: int = EVERY, passage: int = PASSAGE) -> DataFrame:
    """Every document without the repeated chunks.

    Returns doc_id, text (null stays null; a text may become empty), removed_chunks, removed_lines,
    removed_words. The first place of a chunk, which stays, is that of the smallest doc_id (nulls last),
    then of the first row and the first place in its text. Lines end at \\n only. Repeated rows: the first
    keeps its chunks. Empty table: no rows. Other columns are not read. Chunks only, as the SQL twin
    states: a passage of few lines that no chunk covers stays (``deduped_documents`` removes it).
    """
    out = _cut(docs.select("doc_id", "text"), every, passage)

    def total(field: str) -> Column:
        return F.coalesce(F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c[field].cast("long")), F.lit(0)).alias(f"removed_{field}")

    return out.select("row.doc_id", "text", F.coalesce(F.size("cuts"), F.lit(0)).cast("long").alias("removed_chunks"),
                      total("lines"), total("words"))


def deduped_documents(docs: DataFrame, every: int = EVERY, passage: int = PASSAGE) -> DataFrame:
    """The documents with the shortened texts (and n_chars, where there is such a column); all rows stay.

    Removed are the repeated chunks and all repeated runs of whole lines with at least ``passage`` words,
    wherever chunks end; lines without words inside a run don't count. The first place stays.
    """
    out = _cut(docs, every, passage, whole=True)

    def value(c: str) -> Column:
        if c == "n_chars":
            return F.when(F.size("cuts") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType)
        return F.col("text") if c == "text" else F.col("row").getField(c)

    return out.select(*[value(c).alias(c) for c in docs.columns])


SQL = f"""
WITH rows AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS rid, doc_id, text FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM rows WHERE text IS NOT NULL),
hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines),
placed AS (
  SELECT *, lag(h, 1, 0::BIGINT) OVER w AS h0, lead(words, 1, 0) OVER w AS words1, lead(i) OVER w IS NULL AS last
  FROM hashed WINDOW w AS (PARTITION BY rid ORDER BY i)),
ends AS (
  SELECT *, last OR xor(h, h0 * 2) % {EVERY} = 0 OR words >= {PASSAGE} OR words1 >= {PASSAGE} AS ends FROM placed),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ends),
chunks AS (
  SELECT rid, k, count(*) AS n, sum(words) AS words, string_agg(line, chr(10) ORDER BY i) AS bytes FROM numbered GROUP BY rid, k),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY rid, k) > 1 AND (n >= 2 OR words >= {PASSAGE}) AS gone FROM chunks)
SELECT r.doc_id,
  CASE WHEN r.text IS NOT NULL THEN coalesce(string_agg(c.bytes, chr(10) ORDER BY c.k) FILTER (WHERE NOT c.gone), '') END AS text,
  count(*) FILTER (WHERE c.gone) AS removed_chunks, coalesce(sum(c.n) FILTER (WHERE c.gone), 0)::BIGINT AS removed_lines,
  coalesce(sum(c.words) FILTER (WHERE c.gone), 0)::BIGINT AS removed_words
FROM rows r LEFT JOIN ranked c ON r.rid = c.rid GROUP BY r.rid, r.doc_id, r.text
"""
