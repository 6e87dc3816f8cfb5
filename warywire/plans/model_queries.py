"""Registered queries: models.

SQL cannot state a trained model. Queries that train, score or compare therefore return their figures without a twin, and
tests hold them to floors. What SQL can state has one: the matrix with its weights and scaling, the columns' names, held-out
supports, class counts after balancing, scores that agree between one row and the table, sums that close. All settings are the
published ones, whatever the session sets; a model is fitted once per input files and settings and kept in the shared folder.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import explain as EX
from ..operators import extractors as E
from ..operators import features as FE
from ..operators import models as M
from ..operators import ranking as R
from ..operators import stats as ST
from ..operators import training as TN
from ..operators import trees as TR
from ..operators import vectorize as VZ
from ..session import fresh_path, materialize, spread
from .evaluation_queries import _SPLIT_SQL, LABELLED_SQL, labelled
from .feature_queries import FEATURES_SQL
from .inputs import MESSAGES_SQL, messages, sql_list
from .phrases import PHRASES
from .registry import query, tidy
from .vector_queries import terms_sql, vocab_sql

AUC_FLOOR, F1_FLOOR = 0.85, 0.75
_CACHE: dict = {}


def _key(spark, sf_dir, *rest):
    files = tuple(sorted(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").inputFiles()))
    return (spark.sparkContext.applicationId, files, *rest)


def split(spark, sf_dir):
    key = _key(spark, sf_dir, "split")
    if key not in _CACHE:
        _CACHE[key] = materialize(R.stratified_split(labelled(spark, sf_dir)), "split")
    rows = _CACHE[key]
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "val")


def kept(spark, sf_dir, name, settings, fit):
    """A fitted model: of this session, of the shared folder, or fitted now."""
    key = _key(spark, sf_dir, name, tuple(sorted(settings.items())))
    if key not in _CACHE:
        events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
        _CACHE[key] = TN.stored(events, name, settings, lambda: fit(**settings))
    return _CACHE[key]


def trained(spark, sf_dir, kind):
    """A classifier on the production matrix."""
    return kept(spark, sf_dir, kind, M.SETTINGS[kind], lambda **p: M.train(split(spark, sf_dir)[0], kind, **p))


def notebook(spark, sf_dir, version, balanced):
    """Gradient boosting on an extractor's columns."""
    settings = TN.BALANCED if balanced else TN.PLAIN
    return kept(spark, sf_dir, f"gbt-{version}-{'balanced' if balanced else 'plain'}", settings,
                lambda **p: TN.fit_notebook(split(spark, sf_dir)[0], version, balanced, **p))


def text_model(spark, sf_dir):
    """Logistic regression on up to 50,000 terms, categories and lexicon columns."""
    return kept(spark, sf_dir, "text-logistic", M.SETTINGS["logistic"], lambda **p: TN.fit_text(split(spark, sf_dir)[0], "logistic", **p))


def held_out(spark, sf_dir, kind):
    key = _key(spark, sf_dir, kind, "held out")
    if key not in _CACHE:
        scored = M.predictions(trained(spark, sf_dir, kind), spread(split(spark, sf_dir)[1]))
        _CACHE[key] = materialize(scored.select("message_id", "true_label", "predicted", "probability"), "held-out")
    return _CACHE[key]


def report(held):
    """Precision, recall, F1 and support by class, and the area under the curve, of held-out predictions."""
    held = materialize(held.select("message_id", "true_label", "predicted", "probability"), "held-out")
    auc = ST.roc_auc(held).select("roc_auc")
    return tidy(ST.classification_report(held).crossJoin(F.broadcast(auc)))  # one row


for _kind, _name in (("boosted", "train_boosted_trees"), ("forest", "train_random_forest"), ("svm", "train_linear_svm")):
    query(_name)(lambda spark, sf_dir, kind=_kind: report(held_out(spark, sf_dir, kind)))


@query("train_logistic")
def train_logistic(spark, sf_dir):
    model = text_model(spark, sf_dir)
    scored = model.transform(TN.text_rows(split(spark, sf_dir)[1]))
    p = vector_to_array("probability")[1]
    return report(scored.select("message_id", F.col("label").alias("true_label"), p.alias("probability"), (p >= 0.5).cast("int").alias("predicted")))


def _notebook_report(version, balanced):
    def run(spark, sf_dir):
        return report(TN.notebook_predictions(notebook(spark, sf_dir, version, balanced), split(spark, sf_dir)[1], version))
    return run


query("train_gradient_boosting")(_notebook_report("v1", True))
query("train_gradient_boosting_v2")(_notebook_report("v2", True))
query("train_gradient_boosting_v3")(_notebook_report("v3", True))
query("train_gradient_boosting_plain")(_notebook_report("v3", False))


@query("held_out_support", f"""WITH {_SPLIT_SQL} SELECT label::INT AS true_label, count(*) AS support, count(DISTINCT message_id) AS scored
 FROM split WHERE split = 'val' GROUP BY label""")
def held_out_support(spark, sf_dir):
    """Held-out rows by class, each scored once by the text model's rows."""
    val = split(spark, sf_dir)[1]
    scored = TN.text_rows(val).select("message_id").distinct().withColumn("scored", F.lit(1))
    return val.join(scored, "message_id", "left").groupBy(F.col("label").cast("int").alias("true_label")).agg(
        F.count("*").alias("support"), F.count("scored").alias("scored"))


@query("smote_training_counts", f"""WITH {_SPLIT_SQL}, n AS (SELECT label::INT AS label, count(*) AS own FROM split WHERE split = 'train' GROUP BY label)
 SELECT label, max(own) OVER () AS rows, max(own) OVER () - own AS added FROM n""")
def smote_training_counts(spark, sf_dir):
    """Classes after scaling and balancing, as gradient boosting is fitted on them; and rows that were added."""
    rows = TN.notebook_rows(split(spark, sf_dir)[0], "v1")
    names = list(TN.COLUMNS["v1"][1])
    scale = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="matrix"), StandardScaler(
        inputCol="matrix", outputCol="scaled", withMean=True, withStd=True)]).fit(rows)
    balanced = TN.BalancedClassifier(None).balanced(scale.transform(rows))
    return balanced.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("rows"), F.sum((F.col("copy") > 0).cast("long")).alias("added"))


@query("text_model_columns", f"""WITH {_SPLIT_SQL}, learn AS (SELECT * FROM split WHERE split = 'train'), {terms_sql("learn", "message_id", "message_text", 2, stop=False)},
 {vocab_sql(TN.NOTEBOOK_TERMS, TN.NOTEBOOK_MIN_DF)}
 SELECT 'tfidf_' || term AS feature FROM vocab UNION ALL SELECT DISTINCT 'platform_' || platform FROM learn WHERE platform IS NOT NULL
 UNION ALL SELECT DISTINCT 'message_type_' || message_type FROM learn WHERE message_type IS NOT NULL UNION ALL SELECT unnest({sql_list(E.LEXICON_NAMES)})""")
def text_model_columns(spark, sf_dir):
    """The columns that the text model has a coefficient for."""
    model = text_model(spark, sf_dir)
    names = TN.text_feature_names(model)
    if len(names) != model.stages[-1].numFeatures:
        raise ValueError("names and coefficients differ in number")
    return spark.createDataFrame([(n,) for n in names], "feature string")  # at most 50,000 terms and the categories


@query("score_batch")
def score_batch(spark, sf_dir):
    scored = M.score(trained(spark, sf_dir, "boosted"), spread(messages(spark, sf_dir)))
    return tidy(scored.select("message_id", "prediction", "risk_level_predicted"))


@query("score_single", f"""WITH {FEATURES_SQL}, last AS (SELECT * FROM features ORDER BY ts DESC, message_id DESC LIMIT 1)
 SELECT message_id, TRUE AS as_in_batch, weighted_risk_score, word_count FROM last""")
def score_single(spark, sf_dir):
    """The most recent message scored alone, with its features nested; its score is that of the whole table's run."""
    last = messages(spark, sf_dir).orderBy(F.col("ts").desc(), F.col("message_id").desc()).limit(1)
    model = trained(spark, sf_dir, "boosted")
    alone = M.score(model, last, explain=True).select("message_id", "prediction", "features")
    batch = M.score(model, spread(messages(spark, sf_dir))).select("message_id", F.col("prediction").alias("in_batch"))
    return tidy(batch.join(alone, "message_id").select(
        "message_id", (F.abs(F.col("prediction") - F.col("in_batch")) < 1e-9).alias("as_in_batch"),
        "features.weighted_risk_score", "features.word_count"))


_MATRIX_SQL = f"""{_SPLIT_SQL}, learn AS (SELECT * FROM split WHERE split = 'train'), {terms_sql("learn", "message_id", "message_text", 2)}, {vocab_sql(200)},
 names AS (SELECT 'tfidf_' || term AS feature FROM vocab UNION ALL SELECT DISTINCT 'platform_' || platform FROM learn WHERE platform IS NOT NULL
  UNION ALL SELECT DISTINCT 'message_type_' || message_type FROM learn WHERE message_type IS NOT NULL
  UNION ALL SELECT unnest({sql_list(FE.MODEL_FEATURES)}))"""


def _terms_of(source):
    whole = terms_sql(source, "message_id", "message_text", 2)
    return whole[whole.index("AS (") + 3:].replace("SELECT id,", "SELECT id AS message_id,", 1)


@query("design_matrix", f"""WITH {_SPLIT_SQL}, learn AS (SELECT * FROM split WHERE split = 'train'), {terms_sql("learn", "message_id", "message_text", 2)}, {vocab_sql(200)},
 size AS (SELECT count(*) AS n FROM learn), everything AS (SELECT message_id AS id, message_id IN (SELECT message_id FROM learn) AS learnt, terms
   FROM {_terms_of("messages")}),
 raw AS (SELECT id, learnt, t.term, count(*) * (ln((1 + max(n)) / (1 + max(df))) + 1) AS w
   FROM (SELECT id, learnt, unnest(terms) AS term FROM everything) t JOIN vocab v ON v.term = t.term, size GROUP BY id, learnt, t.term),
 parts AS (SELECT id, learnt, 'tfidf_' || term AS feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS value FROM raw
  UNION ALL SELECT message_id, message_id IN (SELECT message_id FROM learn), 'platform_' || platform, 1.0 FROM messages WHERE platform IS NOT NULL
  UNION ALL SELECT message_id, message_id IN (SELECT message_id FROM learn), 'message_type_' || message_type, 1.0 FROM messages WHERE message_type IS NOT NULL),
 scale AS (SELECT feature, sqrt(greatest(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)), 0)) AS deviation
   FROM parts, size WHERE learnt GROUP BY feature)
 SELECT id AS message_id, feature, round(value / CASE WHEN deviation > 0 THEN deviation ELSE 1 END, 5) AS value FROM parts JOIN scale USING (feature) WHERE value <> 0""")
def design_matrix(spark, sf_dir):
    """The scaled term and category entries of every message's row, by name (the other columns are the features' own)."""
    model = trained(spark, sf_dir, "logistic")
    rows = M.preprocessor(model).transform(messages(spark, sf_dir))
    names = F.array(*[F.lit(n) for n in M.feature_names(model)])
    found = rows.select("message_id", F.inline(VZ.entries(F.col("scaled")))).select(
        "message_id", F.element_at(names, F.col("i") + 1).alias("feature"), "value")
    return tidy(found.filter(~F.col("feature").isin(*FE.MODEL_FEATURES)), 5)


def cross_validated(spark, sf_dir):
    """Four kinds over five folds, once per session."""
    key = _key(spark, sf_dir, "folds")
    if key not in _CACHE:
        _CACHE[key] = materialize(TN.compare(labelled(spark, sf_dir), TN.COMPARED, 5), "folds")
    return _CACHE[key]


@query("cross_validate_models")
def cross_validate_models(spark, sf_dir):
    return tidy(cross_validated(spark, sf_dir))


@query("select_best_model")
def select_best_model(spark, sf_dir):
    """The kind of highest mean F1 over the folds, refitted on all rows, with its figures on them."""
    cv, rows = cross_validated(spark, sf_dir), labelled(spark, sf_dir)
    kind = M.best_kind(cv)
    settings = TN.COMPARED[kind]
    model = kept(spark, sf_dir, f"best-{kind}", settings, lambda **p: TN.fit_text(rows, kind, **p))
    right = (F.col("prediction").cast("int") == F.col("label").cast("int")).cast("double")
    top = cv.filter((F.col("metric") == "f1") & (F.col("model") == kind)).first()["mean"]
    return tidy(model.transform(TN.text_rows(rows)).agg(F.count("*").alias("rows"), F.lit(kind).alias("model"), F.lit(top).alias("mean_f1"),
                                                        F.avg(right).alias("accuracy")))


@query("model_save_load", f"WITH {MESSAGES_SQL} SELECT count(*) AS n, 0.0::DOUBLE AS max_difference FROM messages")
def model_save_load(spark, sf_dir):
    """Save, load, and score all messages with both; they must agree."""
    model = trained(spark, sf_dir, "logistic")
    path = fresh_path(spark, "model")
    M.save_model(model, path)
    again = M.load_model(path)
    a = M.score(model, messages(spark, sf_dir)).select("message_id", "prediction")
    b = M.score(again, messages(spark, sf_dir)).select("message_id", F.col("prediction").alias("loaded"))
    return a.join(b, "message_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("prediction") - F.col("loaded"))).alias("max_difference"))


@query("model_card", f"""WITH {_MATRIX_SQL} SELECT 'GBTClassificationModel' AS model_type, array_to_string({sql_list(FE.MODEL_FEATURES)}, ',') AS feature_columns,
 (SELECT count(*) FROM names)::INT AS total_features, count(*) FILTER (split = 'train') AS training_samples,
 count(*) FILTER (split = 'val') AS validation_samples, TRUE AS accurate FROM split""")
def model_card(spark, sf_dir):
    train_rows, val_rows = split(spark, sf_dir)
    card = M.model_card(trained(spark, sf_dir, "boosted"), train_rows, spread(val_rows))
    return card.withColumn("accurate", F.col("test_accuracy") >= F1_FLOOR).drop("test_accuracy")


@query("feature_names", f"""WITH {_MATRIX_SQL} SELECT model, feature FROM names, (SELECT unnest(['boosted', 'logistic']) AS model)""")
def feature_names(spark, sf_dir):
    """The matrix columns that both models know."""
    return feature_importance(spark, sf_dir).select("model", "feature")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Every matrix column of both models: impurity importance, or absolute coefficient."""
    tree = M.importances(trained(spark, sf_dir, "boosted"), spark).withColumn("model", F.lit("boosted"))
    linear = M.importances(trained(spark, sf_dir, "logistic"), spark).withColumn("model", F.lit("logistic"))
    return tidy(tree.unionByName(linear).select("model", "feature", "importance"))


@query("explain_tree_paths", f"WITH {MESSAGES_SQL} SELECT message_id, 35::BIGINT AS parts, TRUE AS closes FROM messages")
def explain_tree_paths(spark, sf_dir):
    """Path contributions of every message: 34 features and the rest; with the base they give the score."""
    model, rows = trained(spark, sf_dir, "boosted"), spread(messages(spark, sf_dir))
    sums = TR.explain_trees(model, rows).groupBy("message_id").agg(
        F.count("*").alias("parts"), (F.sum("contribution") + F.first("base")).alias("margin"))
    scored = M.score(model, rows).select("message_id", "prediction")
    again = 1.0 / (1.0 + F.exp(-2.0 * F.col("margin")))
    return sums.join(scored, "message_id").select("message_id", "parts", (F.abs(again - F.col("prediction")) < 1e-6).alias("closes"))


@query("permutation_importance_model")
def permutation_importance_model(spark, sf_dir):
    """Mean and deviation of the drop in accuracy when an input is permuted over all rows."""
    model = trained(spark, sf_dir, "logistic")
    names = M.feature_names(model)
    of = {c: [n for n in names if n.startswith(f"{c}_")] for c in M.CATEGORIES}
    of["message_text"] = [n for n in names if not any(n in own for own in of.values())]  # terms and features
    # the model is linear: what an input brings to the margin moves with it, so texts are read and scored once
    rows = M.margin_parts(model, labelled(spark, sf_dir).select("message_id", *of, "label"), of).select(
        "message_id", "label", *[f"margin_{c}" for c in of])

    def scorer(df):
        margin = sum((F.col(f"margin_{c}") for c in of), F.lit(float(model.stages[-1].intercept)))
        return df.withColumn("prediction", X.apply_threshold(1.0 / (1.0 + F.exp(-margin))))

    return tidy(EX.permutation_importance(rows, scorer, {c: [f"margin_{c}"] for c in of}))


@query("permutation_importance_columns")
def permutation_importance_columns(spark, sf_dir):
    """The same for every column of the model's matrix."""
    model = trained(spark, sf_dir, "logistic")
    rows = M.preprocessor(model).transform(labelled(spark, sf_dir))
    return tidy(TN.permutation_by_column(model, rows, M.feature_names(model)))


EDGE_TEXTS = [t for t, _ in PHRASES[14:25]]
@query("edge_case_scoring")
def edge_case_scoring(spark, sf_dir):
    """The eleven edge texts under the standard threshold and the two tuned on the held-out messages."""
    best = ST.optimal_thresholds(ST.threshold_sweep(held_out(spark, sf_dir, "logistic"))).first()
    levels = {"standard": 0.5, "high_precision": best["high_precision_threshold"], "high_recall": best["high_recall_threshold"]}
    levels = {k: 0.5 if v is None else v for k, v in levels.items()}
    return tidy(M.score_texts(trained(spark, sf_dir, "logistic"), spark, EDGE_TEXTS, levels).select("message_text", "prediction", *levels))


@query("feature_transformer", f"WITH {FEATURES_SQL} SELECT message_id, {', '.join(FE.FEATURE_NAMES)} FROM features")
def feature_transformer(spark, sf_dir):
    return tidy(M.FeatureTransformer().transform(messages(spark, sf_dir)).select("message_id", *FE.FEATURE_NAMES))
