"""Training at the published size: stored models, balancing inside the fit, and the notebook's own matrices.

A fitted model is kept in the shared folder under its settings and its input files, so later sessions load it.
Oversampling is part of fitting only: the estimator here adds rows before its classifier is fitted, and the model it returns
is the classifier's, which adds none. Folds of a cross-validation share one count of terms and one pass of column
moments; what a fold trains on is the whole less its own part.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVCModel, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, fresh_path, materialize, shared_dir, spread
from . import extractors as E
from . import stats as ST
from .balance import smote
from .models import CATEGORIES, checkpoints, fit_classifier
from .ordered import hash_rank
from .ranking import with_folds
from .vectorize import TermTransformer, TfidfEstimator, idf, tfidf_stages

NOTEBOOK_TERMS, NOTEBOOK_MIN_DF = 50_000, 2
# published settings of the notebook's comparison: default depths (Spark's deepest is 30), 100 trees each
COMPARED = {
    "logistic": {"maxIter": 200},
    "forest": {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 1},
    "gbt": {"maxIter": 100, "maxDepth": 3},
    "svm": {"maxIter": 1000},
}
BALANCED = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.1}
PLAIN = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
COLUMNS = {"v1": (E.features_v1, E.V1_NAMES), "v2": (E.features_v2, E.V2_NAMES), "v3": (E.features_v3, E.V3_NAMES)}


def _fingerprint(df: DataFrame) -> list:
    """Which files, of what size and time, a table is read from, as sums that any number of files gives."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns) % F.lit(1 << 40))).first()
    return list(row)


def stored(source: DataFrame, name: str, settings: dict, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The model of these settings and these input files: loaded if an earlier call has stored it, else fitted and stored.

    The model is written under a name of its own and then renamed, so one that is there is whole.
    """
    spark = source.sparkSession
    key = json.dumps([name, settings, _fingerprint(source)], sort_keys=True, default=str)
    path = f"{shared_dir(spark).rstrip('/')}/models/{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        model = fit()
        made = fresh_path(spark, f"model-{name}")
        model.save(made)
        files.mkdirs(hadoop(f"{shared_dir(spark).rstrip('/')}/models"))
        files.rename(hadoop(made), target)  # if another session was first, its model stays
    return PipelineModel.load(path)


class BalancedClassifier(Estimator):
    """Fits a classifier on rows whose smaller class has been raised to parity by interpolation; scoring adds none."""

    def __init__(self, classifier: Estimator, features: str = "scaled", label: str = "label", ident: str = "message_id",
                 k: int = 5, seed: int = 42) -> None:
        super().__init__()
        self.classifier, self.features, self.label, self.ident, self.k, self.seed = classifier, features, label, ident, k, seed

    def balanced(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.select(self.ident, self.label, vector_to_array(self.features).alias("_vec"))
        rows = materialize(rows, "balance")
        return materialize(smote(rows, "_vec", self.label, self.k, self.seed, self.ident), "balanced")

    def _fit(self, dataset: DataFrame):
        rows = spread(self.balanced(dataset), "id", "copy").select(array_to_vector("_vec").alias(self.features), self.label)
        return self.classifier.fit(rows)


def notebook_rows(df: DataFrame, version: str) -> DataFrame:
    """message_id, label and the columns of one of the three extractors as doubles, written once in even parts."""
    add, names = COLUMNS[version]
    rows = add(spread(df)).select("message_id", "label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    return materialize(rows, "notebook")


def fit_notebook(df: DataFrame, version: str = "v1", balanced: bool = True, seed: int = 42, **params) -> PipelineModel:
    """Gradient boosting on an extractor's columns: scaled and balanced, or plain with default settings.

    The model scores rows that carry the columns (``notebook_rows``, or the extractor's own output).
    """
    rows = notebook_rows(df, version)
    names = list(COLUMNS[version][1])
    options = {"checkpointInterval": 10, **(BALANCED if balanced else PLAIN), **params}
    checkpoints(df.sparkSession)
    classifier = GBTClassifier(featuresCol="scaled", labelCol="label", seed=seed, **options)
    stages = [VectorAssembler(inputCols=names, outputCol="matrix" if balanced else "scaled")]
    if balanced:
        stages += [StandardScaler(inputCol="matrix", outputCol="scaled", withMean=True, withStd=True), BalancedClassifier(classifier)]
    else:
        stages.append(classifier)
    return Pipeline(stages=stages).fit(rows)


def notebook_predictions(model: PipelineModel, df: DataFrame, version: str, t: float = 0.5) -> DataFrame:
    """Scored rows in the shape the metrics take."""
    scored = model.transform(notebook_rows(df, version))
    p = vector_to_array("probability")[1]
    return scored.select("message_id", F.col("label").alias("true_label"), p.alias("probability"), (p >= t).cast("int").alias("predicted"))


def text_rows(df: DataFrame, fold: str | None = None) -> DataFrame:
    """Messages with terms and the lexicon columns, written once in even parts."""
    rows = TermTransformer(removeStop=False).transform(E.features_lexicon(spread(df)))
    lexicon = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in E.LEXICON_NAMES]
    return materialize(rows.select("message_id", *CATEGORIES, "label", "terms", *lexicon, *([fold] if fold else [])), "text-rows")


def text_matrix(size: int = NOTEBOOK_TERMS, min_df: int = NOTEBOOK_MIN_DF, features: Sequence[str] = E.LEXICON_NAMES) -> list:
    """Stages of the notebook's matrix: up to ``size`` terms, one-hot categories and lexicon columns, all sparse."""
    index = StringIndexer(inputCols=list(CATEGORIES), outputCols=[f"{c}_index" for c in CATEGORIES], handleInvalid="keep",
                          stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in CATEGORIES], outputCols=[f"{c}_hot" for c in CATEGORIES])
    return [TfidfEstimator(size=size, min_df=min_df), index, hot,
            VectorAssembler(inputCols=["tfidf", *[f"{c}_hot" for c in CATEGORIES], *features], outputCol="scaled")]


def fit_text(df: DataFrame, kind: str = "logistic", size: int = NOTEBOOK_TERMS, min_df: int = NOTEBOOK_MIN_DF, **params) -> PipelineModel:
    """The notebook's text model: TF-IDF of up to 50,000 terms, categories and the lexicon columns, then a classifier.

    The model scores ``text_rows``.
    """
    rows = text_rows(df)
    matrix = Pipeline(stages=text_matrix(size, min_df)).fit(rows)
    classifier = fit_classifier(materialize(matrix.transform(rows).select("message_id", "label", "scaled"), "text-matrix"), kind, **params)
    return PipelineModel([*matrix.stages, classifier])


def text_feature_names(model: PipelineModel) -> list[str]:
    """Names of the columns of ``fit_text``, in order."""
    words = next(s for s in _leaves(model) if isinstance(s, CountVectorizerModel)).vocabulary
    index = next(s for s in model.stages if hasattr(s, "labelsArray"))
    return [f"tfidf_{w}" for w in words] + [f"{c}_{v}" for c, labels in zip(CATEGORIES, index.labelsArray) for v in labels] + list(E.LEXICON_NAMES)


def _leaves(model: PipelineModel):
    for stage in model.stages:
        if isinstance(stage, PipelineModel):
            yield from _leaves(stage)
        else:
            yield stage


def fold_vocabularies(rows: DataFrame, k: int, size: int, min_df: int) -> list[list[tuple[str, float]]]:
    """For each fold the terms and idf weights that the other folds' rows give, from one count by (term, fold)."""
    seen = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    first = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    exploded = rows.select("fold", F.inline(F.concat(seen, first)))
    counts = exploded.groupBy("term").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
                                            for f in range(k) for c in ("tf", "df")])
    counts = materialize(counts, "fold-terms")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    out = []
    for f in range(k):
        tf, df = (sum(F.col(f"{c}{g}") for g in range(k) if g != f) for c in ("tf", "df"))
        top = counts.select("term", tf.alias("tf"), df.alias("df")).filter(F.col("df") >= min_df).orderBy(
            F.desc("tf"), "term").limit(size)
        docs = total - sizes.get(f, 0)
        out.append([(r["term"], idf(r["df"], docs)) for r in top.collect()])  # at most ``size`` terms
    return out


def compare(df: DataFrame, models: dict[str, dict] = COMPARED, k: int = 5, size: int = NOTEBOOK_TERMS, min_df: int = NOTEBOOK_MIN_DF,
            seed: int = 42, parallel: int = 4) -> DataFrame:
    """Cross-validation of several kinds on the notebook's matrix: (model, metric, mean, spread), spread being twice the deviation.

    Terms are counted once for all folds. Fits of different folds and kinds run side by side, ``parallel`` at a time, as
    jobs of one session.
    """
    spark = df.sparkSession
    rows = text_rows(with_folds(df, "label", k, seed, "message_id"), "fold")
    index = StringIndexer(inputCols=list(CATEGORIES), outputCols=[f"{c}_index" for c in CATEGORIES], handleInvalid="keep",
                          stringOrderType="alphabetAsc").fit(rows)
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in CATEGORIES], outputCols=[f"{c}_hot" for c in CATEGORIES]).fit(index.transform(rows))
    assemble = VectorAssembler(inputCols=["tfidf", *[f"{c}_hot" for c in CATEGORIES], *E.LEXICON_NAMES], outputCol="scaled")
    known = hot.transform(index.transform(rows))

    def matrix(f: int, terms: list[tuple[str, float]]) -> DataFrame:
        weights = tfidf_stages([t for t, _ in terms], [w for _, w in terms])
        return materialize(assemble.transform(weights.transform(known)).select("label", "fold", "scaled"), "fold")

    parts = [matrix(f, terms) for f, terms in enumerate(fold_vocabularies(rows, k, size, min_df))]

    def judged(job: tuple[int, str]) -> list[tuple]:
        f, kind = job
        fitted = fit_classifier(parts[f].filter(F.col("fold") != f), kind, **models[kind])
        held = fitted.transform(parts[f].filter(F.col("fold") == f)).select(
            F.col("label").cast("int").alias("true_label"), F.col("prediction").cast("int").alias("predicted"))
        report = ST.classification_report(held).filter(F.col("class") == "1").first()
        return [] if report is None else [(kind, f, m, float(report[m])) for m in ("f1", "precision", "recall")]

    with ThreadPoolExecutor(parallel) as pool:
        results = [r for found in pool.map(judged, [(f, kind) for f in range(k) for kind in models]) for r in found]
    scores = spark.createDataFrame(results, "model string, fold int, metric string, score double")
    return scores.groupBy("model", "metric").agg(F.avg("score").alias("mean"), (2 * F.stddev_pop("score")).alias("spread"))


def permutation_by_column(model, rows: DataFrame, names: Sequence[str], features: str = "scaled", label: str = "label",
                          ident: str = "message_id", repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): the drop in accuracy when one column of the matrix is permuted.

    For every repeat the rows are put in two pseudo-random orders and the vectors' non-zero entries moved from a row to the row of the
    same rank in the other order. Moving one slot changes only rows that have, or are given, a non-zero entry there; the others
    keep their prediction. Those pairs (row, slot) are judged, by the margin if the model is linear; a column that is zero everywhere has
    importance 0 without any. Rows meet by merge joins: written tables are small for their rows, so a size estimate would broadcast them.
    """
    base = materialize(rows.select(F.col(ident).alias("id"), F.col(label).cast("int").alias("label"), F.col(features).alias("vec")), "permute-rows")
    n = base.count()
    scorer = model.stages[-1] if isinstance(model, PipelineModel) else model
    after = _linear_drops if _level(scorer) is not None else _drops
    judged = materialize(_right(scorer, base, "vec", features), "permute-base")
    out = []
    for rep in range(repeats):
        here = hash_rank(base.select("id"), [], "id", f"{seed}:{rep}:from", "r").select("id", "r")
        there = hash_rank(base.select("id"), [], "id", f"{seed}:{rep}:to", "r").select(F.col("id").alias("to_id"), "r")
        moves = materialize(here.join(there.hint("merge"), "r").select("id", "to_id"), "permute-moves")
        moved = base.select("id", F.col("vec").alias("given")).join(moves.hint("merge"), "id").select(F.col("to_id").alias("id"), "given")
        drops = after(scorer, judged.join(moved.hint("merge"), "id"), len(names), features)
        out += [(r["slot"], rep, r["drop"] / n) for r in drops.collect()]  # columns at most
        discard(moves)
    named = rows.sparkSession.createDataFrame(list(enumerate(names)), "slot int, feature string")
    repeated = named.crossJoin(F.broadcast(rows.sparkSession.range(repeats).select(F.col("id").cast("int").alias("rep"))))  # columns x repeats
    each = repeated.join(rows.sparkSession.createDataFrame(out, "slot int, rep int, drop double"), ["slot", "rep"], "left").fillna(0.0, ["drop"])
    return each.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def _level(scorer) -> float | None:
    """The margin above which a binary linear model predicts 1; None for other models."""
    if isinstance(scorer, LinearSVCModel):
        return scorer.getThreshold()
    if isinstance(scorer, LogisticRegressionModel) and scorer.numClasses == 2 and 0 < scorer.getThreshold() < 1:
        return math.log(scorer.getThreshold() / (1 - scorer.getThreshold()))
    return None


def _changes(pairs: DataFrame, *keep: str) -> DataFrame:
    """(slot, had, given) of every entry that differs between a row's vector and the one given to it."""
    both = F.arrays_zip(vector_to_array("vec").alias("had"), vector_to_array("given").alias("given"))
    return pairs.select(*keep, F.posexplode(both).alias("slot", "e")).select(*keep, "slot", "e.had", "e.given").filter("had <> given")


def _linear_drops(scorer, pairs: DataFrame, size: int, features: str) -> DataFrame:
    """(slot, drop): hits lost by slot. A linear model's margin moves by the coefficient times the change, so no row is scored again."""
    weights = F.array(*[F.lit(float(w)) for w in scorer.coefficients])
    moved = _changes(pairs, "label", "right", "margin").withColumn(
        "now", F.col("margin") + F.element_at(weights, F.col("slot") + 1) * (F.col("given") - F.col("had")) > F.lit(_level(scorer)))
    hit = (F.col("now").cast("int") == F.col("label")).cast("long")
    return moved.groupBy("slot").agg(F.sum(F.col("right").cast("long") - hit).alias("drop"))


def _drops(scorer, pairs: DataFrame, size: int, features: str) -> DataFrame:
    """The same by scoring every changed row."""
    dense = pairs.withColumn("v", vector_to_array("vec"))
    changed = _changes(dense, "label", "right", "v").select("slot", "label", F.col("right").alias("was"), array_to_vector(F.concat(
        F.slice("v", F.lit(1), F.col("slot")), F.array("given"), F.slice("v", F.col("slot") + 2, F.lit(size)))).alias("vec"))
    scored = scorer.transform(changed.withColumnRenamed("vec", features))
    hit = (F.col("prediction").cast("int") == F.col("label")).cast("long")
    return scored.groupBy("slot").agg(F.sum(F.col("was").cast("long") - hit).alias("drop"))


def _right(scorer, rows: DataFrame, vec: str, features: str) -> DataFrame:
    """id, label and vec with whether the model is right, and its margin (null for models without one)."""
    scored = scorer.transform(rows.withColumnRenamed(vec, features))
    margin = vector_to_array("rawPrediction")[1] if "rawPrediction" in scored.columns else F.lit(None).cast("double")
    return scored.select("id", "label", F.col(features).alias(vec), (F.col("prediction").cast("int") == F.col("label")).alias("right"), margin.alias("margin"))
