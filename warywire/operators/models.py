"""Classifiers on the design matrix: training, scoring, comparison, importance, persistence.

A model is one ``PipelineModel``: features and n-grams per row, TF-IDF and one-hot columns,
scaling, classifier. Row features are written once before fitting, since every estimator
passes over them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize, shared_dir, spread
from ..sources.files import literal_messages
from . import stats as ST
from .conform import with_scoring_defaults
from .features import FEATURE_NAMES, MODEL_FEATURES, final_features
from .ranking import with_folds
from .vectorize import PopulationScaler, TermTransformer, TfidfEstimator, entries

CATEGORIES = ("platform", "message_type")
# published settings; pass smaller ones for quick runs
SETTINGS = {
    "boosted": {"maxIter": 500, "maxDepth": 6, "stepSize": 0.1},
    "forest": {"numTrees": 500, "maxDepth": 15, "minInstancesPerNode": 2},
    "logistic": {"maxIter": 200},
    "gbt": {"maxIter": 200, "maxDepth": 5, "stepSize": 0.1},
    "svm": {"maxIter": 1000},
}
BOOST_ROWS = 4_000
CLASSES = {"boosted": GBTClassifier, "forest": RandomForestClassifier, "logistic": LogisticRegression,
           "gbt": GBTClassifier, "svm": LinearSVC}
WEIGHTS = {"boosted": "scale_pos", "forest": "balanced", "logistic": "balanced", "gbt": None, "svm": "balanced"}


class FeatureTransformer(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that adds the 34 production features."""

    def __init__(self, inputCol: str = "message_text"):
        super().__init__()
        self._set(inputCol=inputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return final_features(dataset, self.getInputCol())


def row_stages() -> list[Transformer]:
    return [FeatureTransformer(), TermTransformer()]


def design_matrix_stages(tfidf_size: int = 200, min_df: int = 1, features: Sequence[str] = MODEL_FEATURES,
                         out: str = "scaled") -> list:
    """TF-IDF, one-hot and numeric features in one scaled sparse vector. An unseen category is all zeros."""
    index = StringIndexer(inputCols=list(CATEGORIES), outputCols=[f"{c}_index" for c in CATEGORIES], handleInvalid="keep",
                          stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_index" for c in CATEGORIES], outputCols=[f"{c}_hot" for c in CATEGORIES])
    return [
        TfidfEstimator(size=tfidf_size, min_df=min_df), index, hot,
        VectorAssembler(inputCols=["tfidf", *[f"{c}_hot" for c in CATEGORIES], *features], outputCol="matrix"),
        PopulationScaler("matrix", out),
    ]


def prepared(df: DataFrame) -> DataFrame:
    """Rows with features and n-grams, written once in even parts, so that the passes of a training find all cores."""
    df = spread(df)
    for stage in row_stages():
        df = stage.transform(df)
    return materialize(df, "design")


def fit_matrix(rows: DataFrame, tfidf_size: int = 200) -> PipelineModel:
    """The design matrix stages, fitted on ``prepared`` rows."""
    return Pipeline(stages=design_matrix_stages(tfidf_size)).fit(rows)


def fit_classifier(matrix: DataFrame, kind: str, label: str = "label", seed: int = 42, **params):
    """A classifier fitted on rows that carry the scaled design matrix."""
    options = {**SETTINGS[kind], **params, "featuresCol": "scaled", "labelCol": label}
    if kind not in ("logistic", "svm"):
        # long trainings cut their lineage in the shared folder; a forest's levels also keep where each row is
        options = {"checkpointInterval": 10, "maxMemoryInMB": 512, "cacheNodeIds": kind == "forest", **options, "seed": seed}
        checkpoints(matrix.sparkSession)
    if kind in ("boosted", "gbt"):  # one small job for each level of each tree: no more tasks than the rows are worth
        matrix = matrix.coalesce(max(1, matrix.count() // BOOST_ROWS))
    if WEIGHTS[kind]:
        matrix = ST.with_class_weight(matrix, WEIGHTS[kind], label)
        options["weightCol"] = "weight"
    return CLASSES[kind](**options).fit(matrix)


def checkpoints(spark: SparkSession) -> None:
    """Lets checkpoints go to the shared folder, unless a folder is set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def fit_prepared(rows: DataFrame, kind: str, label: str = "label", tfidf_size: int = 200, **params) -> PipelineModel:
    """Fit the matrix stages and a classifier on ``prepared`` rows; returns the whole pipeline."""
    matrix = fit_matrix(rows, tfidf_size)
    classifier = fit_classifier(matrix.transform(rows), kind, label, **params)
    return PipelineModel([*row_stages(), *matrix.stages, classifier])


def train(df: DataFrame, kind: str, label: str = "label", **params) -> PipelineModel:
    """Train one of boosted, forest, logistic, gbt, svm on message rows with a 0/1 label."""
    return fit_prepared(prepared(df), kind, label, **params)


def score(model: PipelineModel, msgs: DataFrame, explain: bool = False) -> DataFrame:
    """Adds prediction (probability of class 1) and risk_level; ``explain`` adds the features as a struct.

    The same path serves one row and a whole table. Missing platform and type get the defaults.
    """
    keep = msgs.columns
    out = model.transform(with_scoring_defaults(msgs))
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:  # a linear margin
        p = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    extra = [F.struct(*FEATURE_NAMES).alias("features")] if explain else []
    return out.select(*keep, p.alias("prediction"), *extra).withColumn("risk_level_predicted", X.risk_band(F.col("prediction")))


def predictions(model: PipelineModel, df: DataFrame, label: str = "label", t: float = 0.5) -> DataFrame:
    """Scored rows in the shape the metrics take: true_label, probability, predicted."""
    scored = score(model, df).withColumnRenamed("prediction", "probability").withColumnRenamed(label, "true_label")
    return scored.withColumn("predicted", X.apply_threshold(F.col("probability"), t))


def cross_validate(df: DataFrame, models: dict[str, dict], k: int = 5, label: str = "label", ident: str = "message_id",
                   seed: int = 42) -> DataFrame:
    """Mean and 2 x deviation of F1, precision and recall of class 1 over k folds, per model.

    ``models`` maps a kind to its parameters. Each fold fits vocabulary, scaling and
    classifier on its training rows only.
    """
    rows = prepared(with_folds(df, label, k, seed, ident))
    results = []
    for fold in range(k):
        matrix = fit_matrix(rows.filter(F.col("fold") != fold))
        # written once per fold: every model fits on the first part and is judged on the second
        scaled = materialize(matrix.transform(rows).select(label, "fold", "scaled"), "fold")
        inside, outside = scaled.filter(F.col("fold") != fold), scaled.filter(F.col("fold") == fold)
        for kind, params in models.items():
            held = fit_classifier(inside, kind, label, **params).transform(outside)
            pairs = held.select(F.col(label).cast("int").alias("true_label"), F.col("prediction").cast("int").alias("predicted"))
            report = ST.classification_report(pairs).filter(F.col("class") == "1").first()
            if report is not None:
                results += [(kind, fold, m, float(report[m])) for m in ("f1", "precision", "recall")]
    scores = df.sparkSession.createDataFrame(results, "model string, fold int, metric string, score double")
    return scores.groupBy("model", "metric").agg(
        F.avg("score").alias("mean"), (2 * F.stddev_pop("score")).alias("spread"))


def margin_parts(model: PipelineModel, df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Adds for each group of matrix columns what it brings to a linear model's margin, as ``margin_<group>``; the parts and the
    intercept sum to the margin. The features are computed once, whatever is then done to the parts."""
    last, names = model.stages[-1], feature_names(model)
    weights = dict(zip(names, (float(w) for w in last.coefficients)))
    matrix = preprocessor(model).transform(with_scoring_defaults(df))
    out = matrix.withColumn("_entries", entries(F.col(last.getFeaturesCol())))
    for group, columns in groups.items():
        own = F.array(*[F.lit(weights[n] if n in set(columns) else 0.0) for n in names])
        part = F.aggregate("_entries", F.lit(0.0), lambda a, e: a + e["value"] * F.element_at(own, e["i"] + 1))  # noqa: B023
        out = out.withColumn(f"margin_{group}", F.coalesce(part, F.lit(0.0)))
    return out.select(*df.columns, *[f"margin_{group}" for group in groups])


def best_kind(cv: DataFrame) -> str:
    return cv.filter(F.col("metric") == "f1").orderBy(F.col("mean").desc(), "model").first()["model"]


def best_model(cv: DataFrame, df: DataFrame, models: dict[str, dict], label: str = "label") -> PipelineModel:
    """Refit the model of highest mean F1 on all rows."""
    kind = best_kind(cv)
    return train(df, kind, label, **models.get(kind, {}))


def _stage(model: PipelineModel, name: str):
    for stage in model.stages:
        if isinstance(stage, PipelineModel):
            found = _stage(stage, name)
            if found is not None:
                return found
        elif type(stage).__name__ == name:
            return stage
    return None


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the design matrix columns, in order."""
    names = [f"tfidf_{t}" for t in _stage(model, "CountVectorizerModel").vocabulary]
    for col, labels in zip(CATEGORIES, _stage(model, "StringIndexerModel").labelsArray):
        names += [f"{col}_{v}" for v in labels]
    inputs = _stage(model, "VectorAssembler").getInputCols()
    return names + [c for c in inputs if c in MODEL_FEATURES]


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance): impurity importance of trees, absolute coefficients of linear models."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, float(abs(v))) for n, v in zip(feature_names(model), values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def model_card(model: PipelineModel, train_rows: DataFrame, val_rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: features, model type, sample counts, accuracy on the held-out rows."""
    acc = ST.accuracy(predictions(model, val_rows, label)).withColumn("_k", F.lit(1))
    n = train_rows.agg(F.count("*").alias("training_samples")).withColumn("_k", F.lit(1))
    m = val_rows.agg(F.count("*").alias("validation_samples")).withColumn("_k", F.lit(1))
    return n.join(m, "_k").join(acc, "_k").select(
        F.lit(type(model.stages[-1]).__name__).alias("model_type"), F.lit(",".join(MODEL_FEATURES)).alias("feature_columns"),
        F.lit(len(feature_names(model))).alias("total_features"), "training_samples", "validation_samples",
        F.col("accuracy").alias("test_accuracy"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def preprocessor(model: PipelineModel) -> PipelineModel:
    """The pipeline without its classifier."""
    return PipelineModel(model.stages[:-1])


def score_texts(model: PipelineModel, spark: SparkSession, texts: Iterable[str], thresholds: dict[str, float]) -> DataFrame:
    """Score texts given in the program under several named thresholds."""
    scored = score(model, literal_messages(spark, list(texts)))
    return scored.select("message_id", "message_text", "prediction", *[
        F.when(F.col("prediction") >= t, "Suspicious").otherwise("Normal").alias(name) for name, t in thresholds.items()])
