"""Text vectorisation: n-grams, frequency vocabulary, smoothed TF-IDF, one-hot columns.

The vocabulary is one grouped count (the only shuffle); weights are then computed per row
by ml stages on sparse vectors, with no further shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..session import discard, materialize


def term_array(text: Column, n: tuple[int, int] = (1, 2), stop: Iterable[str] = V.STOP_WORDS) -> Column:
    """All n-grams of a text: lower case, words of two or more characters, stop words removed first."""
    return grams(word_array(text, stop), n)


def word_array(text: Column, stop: Iterable[str] = V.STOP_WORDS) -> Column:
    """The words that n-grams are made of."""
    words = X.word_tokens(F.lower(X.text_or_empty(text)))
    stop = list(stop)
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def grams(words: Column, n: tuple[int, int]) -> Column:
    # one inner array per order; the words are bound once so that each row is split once
    return F.flatten(F.transform(F.array(words), lambda ws: F.concat(
        *[X.ngrams_of(ws, k) for k in range(n[0], n[1] + 1)])))


def with_terms(df: DataFrame, text_col: str = "message_text", n: tuple[int, int] = (1, 2),
               stop: Iterable[str] = V.STOP_WORDS, out: str = "terms") -> DataFrame:
    return df.withColumn(out, term_array(F.col(text_col), n, stop))


def with_frequent_terms(df: DataFrame, text_col: str = "message_text", n: tuple[int, int] = (1, 2), stop: Iterable[str] = V.STOP_WORDS,
                        size: int = 200, min_df: int = 1, out: str = "terms", max_words: int = 10_000) -> DataFrame:
    """``with_terms`` less n-grams that cannot be among the ``size`` most frequent, so ``vocabulary`` and ``tfidf`` of that size are the same.

    No n-gram occurs more often than any of its words. Words are counted first (far fewer than n-grams): a term below the
    ``size``-th word's frequency cannot enter, nor can one with such a word. With fewer words than ``size``, or more than
    ``max_words`` of that frequency, all terms are kept.
    """
    if n[0] != 1:
        raise ValueError("the bound needs the words among the terms")
    worded = df.withColumn(out, word_array(F.col(text_col), stop))
    counts = materialize(term_counts(worded, out), "words")
    last = counts.filter(F.col("df") >= min_df).orderBy(F.col("tf").desc()).limit(size).agg(F.count("*"), F.min("tf")).first()
    known = [] if last[0] < size else counts.filter(F.col("tf") >= last[1]).select("term").limit(max_words + 1).collect()
    discard(counts)
    if not known or len(known) > max_words:
        return with_terms(df, text_col, n, stop, out)
    known = [r.term for r in known]
    # a rare word becomes null, and so does every n-gram that holds it
    kept = F.transform(word_array(F.col(text_col), stop), lambda w: F.when(w.isin(*known), w))
    return df.withColumn(out, F.filter(grams(kept, n), lambda t: t.isNotNull()))


def ngrams(df: DataFrame, ident: str = "message_id", **kw) -> DataFrame:
    """Long form: one row per term occurrence."""
    return with_terms(df, **kw).select(ident, F.explode("terms").alias("term"))


def vocabulary(terms: DataFrame, size: int = 200, min_df: int = 1, col: str = "terms") -> DataFrame:
    """The ``size`` most frequent terms with corpus frequency and document frequency.

    Occurrences and first-per-document occurrences travel together, so one aggregation
    with map-side combine gives both counts; frequent terms shrink before the shuffle.
    """
    counts = term_counts(terms, col)
    return counts.filter(F.col("df") >= min_df).orderBy(F.col("tf").desc(), "term").limit(size)


def term_counts(terms: DataFrame, col: str = "terms") -> DataFrame:
    """(term, tf, df) of all terms."""
    seen = F.transform(F.col(col), lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    first = F.transform(F.array_distinct(col), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    return terms.select(F.inline(F.concat(seen, first))).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def idf(df: float, docs: int) -> float:
    return math.log((1 + docs) / (1 + df)) + 1.0


def tfidf_model(terms: DataFrame, size: int = 200, min_df: int = 1, col: str = "terms", out: str = "tfidf") -> PipelineModel:
    """Fit: count terms, weight by ln((1+N)/(1+df)) + 1, scale rows to unit length.

    The driver holds only the vocabulary (at most ``size`` terms).
    """
    rows = vocabulary(terms, size, min_df, col).collect()
    docs = terms.count()
    if not rows:
        raise ValueError("empty vocabulary")
    return tfidf_stages([r.term for r in rows], [idf(r.df, docs) for r in rows], col, out)


def tfidf_stages(words: list[str], weights: list[float], col: str = "terms", out: str = "tfidf") -> PipelineModel:
    """Count the words of a vocabulary, weight them and scale rows to unit length, all on sparse vectors."""
    counts = CountVectorizerModel.from_vocabulary(words, inputCol=col, outputCol=f"{out}_tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=f"{out}_tf", outputCol=f"{out}_raw")
    return PipelineModel([counts, scale, Normalizer(p=2.0, inputCol=f"{out}_raw", outputCol=out)])


def entries(vector: Column) -> Column:
    """The non-zero entries of a vector, sparse or dense, as an array of (i, value)."""
    v = F.unwrap_udt(vector)
    at = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    pairs = F.arrays_zip(at.alias("i"), v["values"].alias("value"))
    return F.when(F.size(v["values"]) > 0, F.filter(pairs, lambda e: e["value"] != 0))


def tfidf(terms: DataFrame, model: PipelineModel, ident: str = "message_id") -> DataFrame:
    """Long form (id, term, weight), weights above 0 only."""
    words = F.array(*[F.lit(t) for t in model.stages[0].vocabulary])
    out = model.transform(terms).select(ident, F.inline(entries(F.col(model.stages[-1].getOutputCol()))))
    return out.select(ident, F.element_at(words, F.col("i") + 1).alias("term"), F.col("value").alias("weight"))


def categories(df: DataFrame, col: str, max_values: int = 1000) -> list[str]:
    """Sorted non-null values of a column, on the driver; more than ``max_values`` is an error."""
    rows = df.select(col).distinct().filter(F.col(col).isNotNull()).limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"{col} has more than {max_values} values")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, cols: Sequence[str], known: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds one 0/1 column per known category; an unknown value gives all zeros."""
    known = known or {c: categories(df, c) for c in cols}
    return df.withColumns({
        f"{c}_{value}": F.coalesce((F.col(c) == value).cast("int"), F.lit(0)) for c in cols for value in known[c]})


class TermTransformer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: text column to n-gram array."""

    maxN = Param(Params._dummy(), "maxN", "longest n-gram", TypeConverters.toInt)
    removeStop = Param(Params._dummy(), "removeStop", "remove stop words", TypeConverters.toBoolean)

    def __init__(self, inputCol: str = "message_text", outputCol: str = "terms", maxN: int = 2, removeStop: bool = True):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, maxN=maxN, removeStop=removeStop)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stop = V.STOP_WORDS if self.getOrDefault(self.removeStop) else ()
        return with_terms(dataset, self.getInputCol(), (1, self.getOrDefault(self.maxN)), stop, self.getOutputCol())


class TfidfEstimator(Estimator, HasInputCol, HasOutputCol):
    """Pipeline stage that fits ``tfidf_model``."""

    def __init__(self, inputCol: str = "terms", outputCol: str = "tfidf", size: int = 200, min_df: int = 1):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.size, self.min_df = size, min_df

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return tfidf_model(dataset, self.size, self.min_df, self.getInputCol(), self.getOutputCol())


class PopulationScaler(Estimator, HasInputCol, HasOutputCol):
    """Pipeline stage: divide by the population deviation without centring (1 where it is 0), so
    sparse vectors stay sparse."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        col = F.col(self.getInputCol())
        row = dataset.select(Summarizer.metrics("std", "count").summary(col).alias("s")).select("s.std", "s.count").first()
        shrink = math.sqrt((row[1] - 1) / row[1]) if row[1] > 1 else 1.0
        factors = [1.0 / (s * shrink) if s * shrink > 0 else 1.0 for s in row[0]]
        return PipelineModel([ElementwiseProduct(
            scalingVec=Vectors.dense(factors), inputCol=self.getInputCol(), outputCol=self.getOutputCol())])
