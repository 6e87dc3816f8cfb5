"""Model invariants, and the shape of plans."""

import math

import pytest
from pyspark.sql import functions as F

from warywire.operators import explain as EX
from warywire.operators import features as FE
from warywire.operators import models as M
from warywire.operators import ordered as O
from warywire.operators import ranking as R
from warywire.operators import stats as ST
from warywire.operators import trees as TR
from warywire.operators import vectorize as VZ
from warywire.plans import evaluation_queries as EQ
from warywire.plans.inputs import messages
from warywire.sources.files import literal_messages


@pytest.fixture(scope="module")
def rows(spark, sf):
    return EQ.labelled(spark, sf)


@pytest.fixture(scope="module")
def boosted(rows):
    return M.train(rows, "boosted", maxIter=4, maxDepth=3)


@pytest.fixture(scope="module")
def logistic(rows):
    return M.train(rows, "logistic", maxIter=20)


def test_logistic_quality_and_range(logistic, rows):
    preds = M.predictions(logistic, rows)
    low, high = preds.agg(F.min("probability"), F.max("probability")).first()
    assert 0 <= low <= high <= 1
    assert ST.roc_auc(preds).first()[0] > 0.85


def test_feature_names_cover_the_matrix(boosted, logistic):
    assert len(M.feature_names(logistic)) == logistic.stages[-1].coefficients.size
    assert len(M.feature_names(boosted)) == boosted.stages[-1].numFeatures


def test_contributions_sum_to_margin_minus_base(spark, boosted, rows):
    some = rows.filter("message_id < 40")
    sums = TR.explain_trees(boosted, some).groupBy("message_id").agg(
        F.sum("contribution").alias("total"), F.first("base").alias("base"), F.count("*").alias("n"))
    p = {r["message_id"]: r["prediction"] for r in M.score(boosted, some).collect()}
    for r in sums.collect():
        assert r["n"] == 35
        assert 1 / (1 + math.exp(-2 * (r["total"] + r["base"]))) == pytest.approx(p[r["message_id"]], abs=1e-6)


def test_save_and_load(spark, logistic, tmp_path):
    path = str(tmp_path / "m")
    M.save_model(logistic, path)
    msgs = literal_messages(spark, ["got that fire plug dm me asap cash only", "hello"])
    a = [r["prediction"] for r in M.score(logistic, msgs).orderBy("message_id").collect()]
    b = [r["prediction"] for r in M.score(M.load_model(path), msgs).orderBy("message_id").collect()]
    assert a == b and a[0] > a[1]


def test_unseen_platform_scores(spark, logistic):
    odd = literal_messages(spark, ["hello"], platform="never seen")
    assert 0 <= M.score(logistic, odd).first()["prediction"] <= 1


def test_a_given_platform_stays(spark, logistic):
    rows = spark.createDataFrame([(1, "Discord", "got fire, dm me")], "message_id long, platform string, message_text string")
    out = M.score(logistic, rows).first()
    assert out["platform"] == "Discord"
    both = rows.withColumn("message_type", F.lit("general"))
    assert out["prediction"] == M.score(logistic, both).first()["prediction"]
    telegram = both.withColumn("platform", F.lit("Telegram"))
    assert out["prediction"] != M.score(logistic, telegram).first()["prediction"]


def test_single_equals_batch(logistic, rows):
    one = rows.filter("message_id = 9")
    alone = M.score(logistic, one, explain=True).first()
    batch = M.score(logistic, rows).filter("message_id = 9").first()
    assert alone["prediction"] == pytest.approx(batch["prediction"])
    assert alone["features"]["char_count"] is not None


def test_svm_has_probabilities(rows):
    model = M.train(rows, "svm", maxIter=3)
    low, high = M.score(model, rows).agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= low < high <= 1


def test_tfidf_rows_have_unit_length(spark, sf):
    terms = VZ.with_terms(messages(spark, sf)).select("message_id", "terms")
    norms = VZ.tfidf(terms, VZ.tfidf_model(terms)).groupBy("message_id").agg(F.sum(F.col("weight") ** 2).alias("n2"))
    low, high = norms.agg(F.min("n2"), F.max("n2")).first()
    assert low == pytest.approx(1) and high == pytest.approx(1)


# --- plans ---
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_narrow_pass(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    from warywire.plans.inputs import derive_messages
    text = plan(FE.final_features(derive_messages(events)))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_scan_reads_needed_columns_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("message_id"), F.col("text").alias("message_text"))
    assert "ReadSchema: struct<text:string>" in plan(FE.has_price(docs).groupBy("has_price").count())


def test_metadata_filter_prunes_folders(spark, sf, tmp_path):
    from warywire.operators.conform import filter_metadata
    from warywire.sources.files import append_store, read_store
    path = str(tmp_path / "store")
    append_store(messages(spark, sf).select("message_id", "platform", "risk_level"), path)
    text = plan(filter_metadata(read_store(spark, path), "Telegram", "high"))
    assert "PartitionFilters: [isnotnull(platform" in text and "PushedFilters: [IsNotNull(risk_level), EqualTo(risk_level,high)]" in text


def test_threshold_counts_score_once(spark, sf):
    scored = FE.final_features(messages(spark, sf)).withColumn("probability", FE.rule_probability()).withColumn(
        "true_label", F.lit(1)).select("true_label", "probability")
    text = plan(ST.threshold_sweep(scored))
    assert "isnotnull(coalesce" not in text and text.count("FileScan") == 1


def test_rank_shuffles_rows_once(spark):
    df = spark.range(1000).select(F.col("id").alias("message_id"), (F.col("id") % 2).alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(R.with_folds(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows once, bucket counts for the grouping and for the offsets
    assert text.count("Exchange hashpartitioning") <= 4
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_sample_plan_is_top_n(spark):
    assert "TakeOrderedAndProject" in plan(O.sample_n(spark.range(100).withColumnRenamed("id", "message_id"), 5))


def test_permuting_inputs_of_a_linear_model_scores_no_text_again(spark, sf, monkeypatch):
    from warywire.plans import model_queries as Q

    model, rows = Q.trained(spark, sf, "logistic"), Q.labelled(spark, sf)
    groups = {"platform": [n for n in M.feature_names(model) if n.startswith("platform_")]}
    groups["rest"] = [n for n in M.feature_names(model) if n not in groups["platform"]]
    parts = {r.message_id: r for r in M.margin_parts(model, rows, groups).collect()}
    for r in M.score(model, rows).select("message_id", "prediction").collect():
        p = parts[r.message_id]
        assert 1 / (1 + math.exp(-(p.margin_platform + p.margin_rest + model.stages[-1].intercept))) == pytest.approx(r.prediction)
    monkeypatch.setattr(M, "score", None)
    found = {r.feature: r.importance_mean for r in Q.permutation_importance_model(spark, sf).collect()}
    assert set(found) == {"platform", "message_type", "message_text"} and found["message_text"] > 0.2


def test_two_contributions_of_a_flag_are_in_the_plan(spark, sf):
    """Values as by row, null where the flag is, and no rounding or interpreted comparison left for the rows."""
    flags = list(EX.SCORE_WEIGHTS)
    rows = FE.final_features(messages(spark, sf)).select("message_id", *flags)
    rows = rows.withColumn(flags[0], F.when(F.col("message_id") % 7 != 3, F.col(flags[0])))
    means = EX.flag_means(rows)
    for digits in (None, 9):
        found = EX.contributions(rows, means, digits)
        by_row = [(F.col(c).cast("int") - F.lit(means[c])) * EX.SCORE_WEIGHTS[c] for c in flags]
        by_row = by_row if digits is None else [F.round(v, digits) for v in by_row]
        held = F.map_from_entries("contributions")
        apart = [~held[c].eqNullSafe(v) for c, v in zip(flags, by_row)]
        assert found.filter(F.array_contains(F.array(*apart), True)).count() == 0
    assert found.filter(held[flags[0]].isNull()).count() > 0
    plan = EX.top_contributions(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "array_sort" not in plan
