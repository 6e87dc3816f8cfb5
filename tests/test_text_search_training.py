import math
import os
import random
import time
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from warywire.operators import models as M
from warywire.operators import text_search as TS
from warywire.operators import training as TN
from warywire.operators import vectorize as VZ
from warywire.plans import evaluation_queries as EQ
from warywire.plans import model_queries as Q
from warywire.session import spread

CORPUS = "id long, document string, platform string, risk_level string"


def corpus(spark, rows):
    return spark.createDataFrame(rows, CORPUS)


def brute(rows, queries, limit, platform=None):
    """Every text scored against every query, unigrams only (texts of one-word steps apart from stop words)."""
    def grams(text):
        words = text.lower().split()
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    texts = {}
    for ident, text, place, _ in rows:
        if text is not None:
            texts.setdefault(text.strip().lower(), []).append((ident, place))
    df = Counter(t for text in texts for t in grams(text))

    def vector(text):
        w = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    known = {t: vector(t) for t in texts}
    out = {}
    for q, text in queries:
        v = vector(text)
        hits = []
        for t, ids in texts.items():
            ids = [i for i, p in ids if platform in (None, p)]
            shared = [v[x] * known[t][x] for x in v if x in known[t]]
            if ids and shared:
                hits.append((round(max(0.0, 2 - 2 * sum(shared)), 9), min(ids)))
        out[q] = [i for _, i in sorted(hits)[:limit]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("per_block", [4, 128])
def test_search_by_text_is_exact(spark, per_block):
    draw = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(2, 9))), draw.choice("ab"), "low") for i in range(300)]
    rows += [(1000 + i, rows[i][1].upper() + " ", "a", "low") for i in range(50)] + [(2000, None, "a", "low"), (2001, "", "a", "low")]
    queries = [(i, " ".join(draw.choices(words, k=4))) for i in range(15)] + [(99, "nothing shared here")]
    index = TS.build_index(corpus(spark, rows), per_block)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    want = {q: ids for q, ids in brute(rows, queries, 5).items() if ids}
    assert found(TS.search_texts(index, asked).collect()) == want
    want = {q: ids for q, ids in brute(rows, queries, 3, "b").items() if ids}
    assert found(TS.search_texts(index, asked, 3, "b").collect()) == want


def test_copies_never_shorten_an_answer(spark):
    rows = [(i, "red green blue", "a", "low") for i in range(500)] + [(600 + i, f"red other{i} thing{i}", "a", "low") for i in range(6)]
    hits = TS.search_texts(TS.build_index(corpus(spark, rows)), spark.createDataFrame([(1, "red green")], "query_id long, text string")).collect()
    assert len(hits) == 5 and sorted(hits, key=lambda r: r.rank)[0].id == 0
    assert TS.search_texts(TS.build_index(corpus(spark, [])), spark.createDataFrame([(1, "red")], "query_id long, text string")).count() == 0


def test_entries_of_sparse_and_dense_vectors(spark):
    rows = spark.createDataFrame([(1, Vectors.sparse(4, [1, 3], [2.0, 0.0])), (2, Vectors.dense([0.0, 5.0])), (3, Vectors.sparse(3, [], []))], ["id", "v"])
    out = rows.select("id", F.inline(VZ.entries(F.col("v")))).collect()
    assert {(r.id, r.i, r.value) for r in out} == {(1, 1, 2.0), (2, 1, 5.0)}


def test_balancing_is_part_of_fitting_only(spark, sf):
    train, val = Q.split(spark, sf)
    model = TN.fit_notebook(train, "v1", True, maxIter=3, maxDepth=2)
    scored = TN.notebook_predictions(model, val, "v1")
    assert scored.count() == val.count()
    plain = TN.fit_notebook(train, "v3", False, maxIter=3, maxDepth=2)
    assert TN.notebook_predictions(plain, val, "v3").count() == val.count()


def test_models_are_stored_once(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    calls = []

    def fit():
        calls.append(1)
        return TN.fit_notebook(Q.split(spark, sf)[0], "v3", False, maxIter=2, maxDepth=2)

    name = f"test-{random.random()}"
    first, again = TN.stored(events, name, {"a": 1}, fit), TN.stored(events, name, {"a": 1}, fit)
    assert len(calls) == 1 and first.stages[-1].toDebugString == again.stages[-1].toDebugString
    TN.stored(events, name, {"a": 2}, fit)
    assert len(calls) == 2


def test_fold_vocabularies_equal_those_of_each_fold_alone(spark, sf):
    rows = TN.text_rows(TN.with_folds(Q.labelled(spark, sf), "label", 3, 42, "message_id"), "fold")
    shared = TN.fold_vocabularies(rows, 3, 60, 2)
    for f in range(3):
        alone = VZ.tfidf_model(rows.filter(F.col("fold") != f), 60, 2)
        assert [t for t, _ in shared[f]] == list(alone.stages[0].vocabulary)
        assert [w for _, w in shared[f]] == pytest.approx(alone.stages[1].getScalingVec().toArray().tolist())


def test_comparison_has_a_row_for_each_kind_and_metric(spark, sf):
    small = {"logistic": {"maxIter": 5}, "gbt": {"maxIter": 2, "maxDepth": 2}}
    rows = TN.compare(Q.labelled(spark, sf), small, 2, size=50).collect()
    assert {(r.model, r.metric) for r in rows} == {(k, m) for k in small for m in ("f1", "precision", "recall")}
    assert all(0.6 < r["mean"] <= 1 and r.spread >= 0 for r in rows)


def test_importance_by_column_as_by_permuting_each(spark):
    from pyspark.ml.classification import LogisticRegression

    from warywire.operators.ordered import hash_rank

    draw = random.Random(2)
    rows = [(i, (y := draw.randint(0, 1)), Vectors.dense([y * draw.random(), float(draw.random() < 0.1), 0.0])) for i in range(200)]
    df = spark.createDataFrame(rows, ["message_id", "label", "scaled"])
    model = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=20).fit(df)
    got = {r.feature: (r.importance_mean, r.importance_std) for r in TN.permutation_by_column(model, df, ["a", "b", "c"], repeats=2, seed=7).collect()}
    right = lambda d: {r.message_id: r.prediction == r.label for r in model.transform(d).collect()}
    base = sum(right(df).values())
    drops = {c: [] for c in "abc"}
    for rep in range(2):
        ids = df.select(F.col("message_id").alias("id"))
        here = {r.id: r.r for r in hash_rank(ids, [], "id", f"7:{rep}:from", "r").collect()}
        there = {r.r: r.id for r in hash_rank(ids, [], "id", f"7:{rep}:to", "r").collect()}
        values = {i: v.toArray().tolist() for i, _, v in rows}
        for slot, c in enumerate("abc"):
            new = {i: list(v) for i, v in values.items()}
            for i in values:
                new[there[here[i]]][slot] = values[i][slot]
            moved = spark.createDataFrame([(i, y, Vectors.dense(new[i])) for i, y, _ in rows], df.schema)
            drops[c].append((base - sum(right(moved).values())) / len(rows))
    for c in "abc":
        mean = sum(drops[c]) / 2
        assert got[c] == pytest.approx((mean, abs(drops[c][0] - mean)))
    assert got["c"] == (0.0, 0.0) and got["a"][0] > 0.1


def test_figures_of_trained_models_lie_above_floors(spark, sf):
    for name in ("train_logistic", "train_gradient_boosting", "train_boosted_trees"):
        for r in Q.query.__globals__["QUERIES"][name](spark, sf).collect():
            assert r.roc_auc > 0.85 and 0 <= r.precision <= 1
            assert r["class"] != "weighted avg" or r.f1 > 0.75
    scored = Q.score_batch(spark, sf)
    assert scored.filter(~F.col("prediction").between(0, 1)).count() == 0


def test_terms_beyond_the_usual_size(spark):
    words = [(i, [f"t{i}", f"t{i}", f"u{i % 7}"]) for i in range(3000)]
    rows = spark.createDataFrame(words, "message_id long, terms array<string>")
    model = VZ.tfidf_model(rows, 50_000, 1)
    assert len(model.stages[0].vocabulary) == 3007
    sizes = model.transform(rows).select(F.size(vector_to_array("tfidf")).alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [3007]


def test_a_linear_model_scores_the_rows_once_for_all_columns(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    draw = random.Random(3)
    rows = [(i, (y := draw.randint(0, 1)), Vectors.sparse(3, {0: y * draw.random(), 1: float(draw.random() < 0.2)})) for i in range(150)]
    df = spark.createDataFrame(rows, ["message_id", "label", "scaled"])

    def figures(m):
        return {r.feature: (r.importance_mean, r.importance_std) for r in TN.permutation_by_column(m, df, ["a", "b", "c"], repeats=3, seed=4).collect()}

    for model in (LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=10).fit(df), LinearSVC(featuresCol="scaled", labelCol="label", maxIter=10).fit(df)):
        calls, plain = [], type(model).transform
        monkeypatch.setattr(type(model), "transform", lambda self, *a: calls.append(1) or plain(self, *a))
        got = figures(model)
        assert len(calls) == 1
        monkeypatch.setattr(TN, "_level", lambda scorer: None)  # the way of other models
        for feature, pair in figures(model).items():
            assert pair == pytest.approx(got[feature])
        assert got["a"][0] > 0.1
        monkeypatch.undo()


def test_the_index_numbers_texts_and_keeps_no_wide_tables(spark):
    rows = [(1, "red green", "a", "low"), (2, "RED green ", "b", "low"), (3, "red green", "b", "high"), (4, "blue blue blue", None, "low"), (5, None, "a", "low")]
    index = TS.build_index(corpus(spark, rows), 1)
    assert dict(index.members.dtypes)["text"] == "bigint" and index.texts == 2  # numbers, no hashes of 32 letters, in every shuffle
    by = {}
    for r in index.members.collect():
        by.setdefault(r.text, set()).add((r.id, r.platform, r.risk_level))
    assert sorted(map(sorted, by.values())) == [[(1, "a", "low"), (2, "b", "low"), (3, "b", "high")], [(4, None, "low")]]
    norms = {}
    for r in index.postings.collect():
        for e in r.entries:
            norms[e.text] = norms.get(e.text, 0.0) + e.weight ** 2
    assert set(norms) == set(by) and all(v == pytest.approx(1.0) for v in norms.values())


def test_training_rows_lie_in_even_parts_whatever_the_input_lay_in(spark):
    """Before, rows written from one part were trained on in one task."""
    rows = EQ.labelled(spark, "/root/testdata/sf0.01").coalesce(1)  # 10,000 rows
    for prepare in (M.prepared, lambda df: TN.notebook_rows(df, "v3"), TN.text_rows):
        sizes = [r["count"] for r in prepare(rows).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 10_000 and len(sizes) == 2 and max(sizes) < 1.2 * min(sizes)


def test_spread_gives_the_same_rows_in_the_same_order(spark):
    rows = spark.range(50_000).withColumnRenamed("id", "message_id")
    parts = [[[r[0] for r in p] for p in spread(df).rdd.glom().collect()] for df in (rows.coalesce(1), rows.repartition(7))]
    assert parts[0] == parts[1] and len(parts[0]) == 8 and sorted(sum(parts[0], [])) == list(range(50_000))
    assert spread(rows, most=1_000).rdd.getNumPartitions() == 56 and spread(rows.limit(10)).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("n", [(1, 2), (1, 3)])
def test_terms_left_out_before_counting_are_never_among_the_most_frequent(spark, n):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 12))) for _ in range(200)] + [None, "w0 w0 w0 w0"]
    df = spark.createDataFrame(list(enumerate(texts)), "message_id long, message_text string")
    every = VZ.with_terms(df, n=n, stop=())
    total = every.agg(F.sum(F.size("terms"))).first()[0]
    for size, min_df in ((3, 1), (10, 2), (10, 20), (39, 1)):
        some = VZ.with_frequent_terms(df, n=n, stop=(), size=size, min_df=min_df)
        assert VZ.vocabulary(some, size, min_df).collect() == VZ.vocabulary(every, size, min_df).collect()
        assert size > 30 or some.agg(F.sum(F.size("terms"))).first()[0] < total
    for whole in ({"size": 41}, {"size": 10, "max_words": 5}):  # no bound from fewer words; too many words to send along
        assert VZ.with_frequent_terms(df, n=n, stop=(), **whole).agg(F.sum(F.size("terms"))).first()[0] == total


def test_no_session_setting_cuts_the_numbers_of_trees(spark, sf, monkeypatch):
    assert spark.conf.get("spark.warywire.rounds.divisor") == "50"  # what sessions once divided them by
    asked = {}
    monkeypatch.setattr(Q, "_CACHE", {})
    monkeypatch.setattr(Q, "kept", lambda spark, sf_dir, name, settings, fit: asked.setdefault(name, dict(settings)))
    for kind in Q.M.SETTINGS:
        Q.trained(spark, sf, kind)
        assert asked[kind] == Q.M.SETTINGS[kind]
    for version, balanced in (("v1", True), ("v2", True), ("v3", True), ("v3", False)):
        Q.notebook(spark, sf, version, balanced)
        assert asked[f"gbt-{version}-{'balanced' if balanced else 'plain'}"] == (TN.BALANCED if balanced else TN.PLAIN)
    models = []
    monkeypatch.setattr(TN, "compare", lambda df, settings, k: models.append((settings, k)) or df.limit(1))
    Q.cross_validated(spark, sf)
    assert models == [(TN.COMPARED, 5)]


def test_building_an_index_leaves_no_shuffle_files_and_shuffles_a_part_of_the_postings_at_a_time(spark, sf):
    """Before, all postings were shuffled twice, and those files lay there until the driver collected garbage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("lang").alias("platform"), F.lit("low").alias("risk_level"))
    places, largest = disk_files(spark), []
    write = TS.materialize

    def watched(df, name="step", **how):
        held = places()
        out = write(df, name, **how)
        largest.append((name, how.get("clean"), places() - held))
        return out

    TS.materialize, before = watched, places()
    try:
        whole, parted = TS.build_index(docs, parts=1), TS.build_index(docs, parts=4)
    finally:
        TS.materialize = write
    for _ in range(50):  # files go in the background
        if places() <= before:
            break
        time.sleep(0.2)
    assert places() <= before and all(clean for _, clean, _ in largest)
    assert [n for n, _, _ in largest].count("text-postings") == 5
    rows = [{(r.term, r.block, round(r.most, 9), tuple(sorted((e.text, round(e.weight, 9)) for e in r.entries))) for r in i.postings.collect()}
            for i in (whole, parted)]
    assert rows[0] == rows[1] and rows[0]


def disk_files(spark):
    """A function that counts the bytes of shuffle files this session's process holds."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return lambda: sum(os.path.getsize(os.path.join(at, f)) for folder in manager.localDirsString()
                       for at, _, files in os.walk(folder) for f in files if f.startswith("shuffle_") and os.path.exists(os.path.join(at, f)))
