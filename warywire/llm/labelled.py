"""Bounded, deterministic samples of labelled documents for fitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LONG_WORD = 8
MANY = 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % folds).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int,
           keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, label, text, and the columns ``keep``) of about ``bound`` labelled rows for which ``learn`` holds, at most; all if fewer.

    Rows are chosen by a hash of the id, so reruns agree. Of texts with one label that share the two
    smallest hashes of their many long words (copies and most near copies do), or that are equal, one is
    kept, so that a copied text doesn't count as many. Rows without text or label are left out. The chosen labels are broadcast: there are at most
    ``bound`` of them, up to the scatter of the hash, whatever the size of the tables.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(learn).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("label"))
    n = marked.count()
    if n > bound:
        cells = 1 << 30
        marked = marked.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(cells)) < int(cells * bound / n))
    chosen = docs.select("doc_id", "text", *keep).filter(F.col("text").isNotNull()).join(F.broadcast(marked), "doc_id")
    long_words = F.filter(F.split("text", " "), lambda w: F.length(w) >= LONG_WORD)
    least = F.array_sort(F.array_distinct(F.transform(long_words, lambda w: F.xxhash64(w))))
    sketch = F.when(F.size(least) >= MANY, F.concat_ws("|", F.slice(least, 1, 2).cast("array<string>"))).otherwise(F.sha2("text", 256))
    texts = chosen.groupBy(sketch.alias("sketch"), "label").agg(F.min(F.struct("doc_id", "text", *keep)).alias("one"))
    return materialize(texts.select("label", "one.*"), "labelled")
