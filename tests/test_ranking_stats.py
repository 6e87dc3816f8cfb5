"""Ranks, running totals, quantiles, metrics: against plain Python on fixtures with ties and hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from warywire.operators import ordered as O
from warywire.operators import ranking as R
from warywire.operators import stats as ST


def preds(spark, rows):
    return spark.createDataFrame(
        [(i, y, int(p >= 0.5), float(p)) for i, (y, p) in enumerate(rows)],
        "message_id long, true_label int, predicted int, probability double")


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(7)
    return [(int(rng.random() < 0.4), rng.choice([0.1, 0.3, 0.5, 0.5, 0.5, rng.random()])) for _ in range(500)]


def test_auc_with_ties(spark, scored):
    pos = [p for y, p in scored if y]
    neg = [p for y, p in scored if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert ST.roc_auc(preds(spark, scored)).first()[0] == pytest.approx(want)


def test_auc_of_one_class_is_null(spark):
    assert ST.roc_auc(preds(spark, [(1, 0.2), (1, 0.9)])).first()[0] is None


def test_curves(spark, scored):
    p = preds(spark, scored)
    roc = ST.roc_curve(p).collect()
    n, m = sum(y for y, _ in scored), sum(1 - y for y, _ in scored)
    for r in roc:
        if r["threshold"] is not None:
            assert r["tpr"] == pytest.approx(sum(y for y, q in scored if q >= r["threshold"]) / n)
            assert r["fpr"] == pytest.approx(sum(1 - y for y, q in scored if q >= r["threshold"]) / m)
    assert len(roc) == len({q for _, q in scored}) + 1
    assert sum(r["threshold"] is None for r in ST.pr_curve(p).collect()) == 1


def test_threshold_sweep_and_optimum(spark, scored):
    sweep = {round(r["threshold"], 9): r for r in ST.threshold_sweep(preds(spark, scored)).collect()}
    assert len(sweep) == 100
    for t, r in sweep.items():
        tp = sum(y for y, p in scored if p >= r["threshold"])
        fp = sum(1 - y for y, p in scored if p >= r["threshold"])
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert r["recall"] == pytest.approx(tp / sum(y for y, _ in scored))
    none = ST.optimal_thresholds(ST.threshold_sweep(preds(spark, [(0, 0.3), (1, 0.2)]))).first()
    assert none["high_precision_threshold"] is None


def test_report_leaves_out_absent_class(spark):
    report = {r["class"]: r for r in ST.classification_report(preds(spark, [(1, 0.9), (1, 0.8)])).collect()}
    assert "0" not in report and report["macro avg"]["f1"] == 1.0 and report["accuracy"]["support"] == 2


def test_no_rows(spark):
    empty = preds(spark, [(0, 0.1)]).limit(0)
    assert [tuple(r) for r in ST.confusion_matrix(empty).collect()] == [(0, 0, 0), (1, 0, 0)]


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantiles_match_numpy(spark, p):
    rng = random.Random(3)
    values = [rng.choice([1.0, 1.0, 2.5, rng.gauss(0, 9)]) for _ in range(313)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    assert O.quantiles(df, "v", {"q": p}).first()["q"] == pytest.approx(np.percentile(values, 100 * p))
    for r in O.quantiles(df, "v", {"q": p}, ["g"]).collect():
        assert r["q"] == pytest.approx(np.percentile(values[r["g"]::2], 100 * p))


def test_hash_rank_is_a_permutation_per_group_even_if_one_group_is_hot(spark):
    df = spark.range(5000).select(F.col("id").alias("message_id"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 3 == 1, F.concat(F.lit("g"), F.col("id") % 50)).alias("label"))
    out = O.hash_rank(df, ["label"], "message_id").collect()
    groups = {}
    for r in out:
        groups.setdefault(r["label"], []).append(r["rank"])
        assert r["group_rows"] > 0
    assert len(out) == 5000
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())


def test_split_and_folds(spark):
    df = spark.range(1000).select(F.col("id").alias("message_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    parts = {(r["label"], r["split"]): r["n"] for r in R.stratified_split(df).groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert parts == {(0, "train"): 720, (0, "val"): 180, (1, "train"): 80, (1, "val"): 20}
    folds = R.with_folds(df).groupBy("label", "fold").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {180, 20}


def test_sample_is_exact(spark):
    df = spark.range(3000).withColumnRenamed("id", "message_id")
    keyed = df.select("message_id", O.hash_key(F.col("message_id"), 42).alias("h")).collect()
    want = {r["message_id"] for r in sorted(keyed, key=lambda r: r["h"])[:700]}
    assert {r[0] for r in O.sample_n(df, 700).collect()} == want
    assert O.sample_n(df, 9000).count() == 3000


def test_running_totals_with_groups(spark):
    rows = [(g, float(v), v + 1) for g in ("a", "b") for v in range(40)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for r in O.running_totals(df, ["v"], ["n"], ["g"], descending=True).collect():
        assert r["cum_n"] == sum(n for g, v, n in rows if g == r["g"] and v >= r["v"])
        assert r["total_n"] == 820


def test_running_count_splits_a_busy_user(spark):
    df = spark.range(400).select(F.col("id").alias("message_id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("u"))
    out = O.running_count(df, ["u"], "message_id", F.floor(F.col("message_id") / 7), "message_id").filter("u = 1")
    got = [r["running_count"] for r in out.orderBy("message_id").collect()]
    assert got == list(range(1, len(got) + 1))


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0), (2.0, 1.0, 5.0)], "x double, y double, c double")
    got = {r["feature"]: r["r"] for r in ST.label_correlation(df, ["x", "c"], "y").collect()}
    assert got["x"] == pytest.approx(1.0) and got["c"] is None


def test_standardize_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert [tuple(r) for r in ST.standardize(df, ["x", "c"]).orderBy("x").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_class_weights_one_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert {r["weight"] for r in ST.with_class_weight(df).collect()} == {1.0}
    assert {r["weight"] for r in ST.with_class_weight(df, "scale_pos").collect()} == {1.0}


def test_null_groups_are_ranked_too(spark):
    df = spark.range(30).select(F.col("id").alias("message_id"), F.when(F.col("id") < 10, F.lit("x")).alias("label"))
    out = R.with_folds(df).groupBy("label", "fold").count().collect()
    assert len(out) == 10 and {(r["label"], r["count"]) for r in out} == {("x", 2), (None, 4)}
