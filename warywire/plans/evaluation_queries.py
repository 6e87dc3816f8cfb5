"""Registered queries: statistics, evaluation, ranking, splits and explanation.

The rule score as a fraction of its maximum serves as a deterministic probability.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import explain as EX
from ..operators import extractors as E
from ..operators import features as FE
from ..operators import ordered as O
from ..operators import ranking as R
from ..operators import stats as ST
from ..session import materialize
from ..sources import files as S
from .extractor_queries import EXT_SQL, V1
from .feature_queries import FEATURES_SQL
from .inputs import MESSAGES_SQL, messages, quote, table
from .phrases import PHRASES
from .registry import query, tidy
from .source_queries import BAND_SQL, PREDS_SQL, scored

EVAL = ("message_id", "platform", "message_type", "message_text", "true_label", "predicted", "probability")


def preds(spark, sf_dir):
    return scored(spark, sf_dir).select(*EVAL)


LABELLED_SQL = f"""{MESSAGES_SQL}, labelled AS (SELECT *, CASE WHEN risk_level IN ('high', 'medium') THEN 1 ELSE 0 END AS label FROM messages)"""


def labelled(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("label", X.label_binary(F.col("risk_level")))


# --- counts ---
@query("value_counts", f"""WITH {MESSAGES_SQL} SELECT 'risk_level' AS col, risk_level AS val, count(*) AS n FROM messages GROUP BY ALL
 UNION ALL SELECT 'platform', platform, count(*) FROM messages GROUP BY ALL""")
def value_counts(spark, sf_dir):
    return R.value_counts_of(messages(spark, sf_dir), ("risk_level", "platform"))


_CONTAINS = f"CAST(len(regexp_extract_all(coalesce(message_text, ''), '[{V.EMOJI}]')) > 0 AS VARCHAR)"


@query("value_counts_topn", f"""WITH {MESSAGES_SQL},
 a AS (SELECT 'message_text' AS col, message_text AS val, count(*) AS n FROM messages GROUP BY ALL ORDER BY n DESC, val NULLS LAST LIMIT 5),
 b AS (SELECT 'message_type', message_type, count(*) AS n FROM messages GROUP BY ALL ORDER BY n DESC, message_type LIMIT 5),
 c AS (SELECT 'contains_emoji', {_CONTAINS} AS v, count(*) AS n FROM messages GROUP BY ALL ORDER BY n DESC, v LIMIT 5)
 SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def value_counts_topn(spark, sf_dir):
    msgs = FE.emoji_features(messages(spark, sf_dir)).withColumn("contains_emoji", (F.col("emoji_count") > 0).cast("string"))
    return R.value_counts_of(msgs, ("message_text", "message_type", "contains_emoji"), 5)


_SPLIT_SQL = f"""{LABELLED_SQL}, ranked AS (SELECT *, md5('42:' || message_id) AS h,
   row_number() OVER (PARTITION BY label ORDER BY md5('42:' || message_id), message_id) AS rank,
   count(*) OVER (PARTITION BY label) AS group_rows FROM labelled),
 split AS (SELECT *, CASE WHEN rank <= round(group_rows * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split, (rank - 1) % 5 AS fold FROM ranked)"""


@query("label_distribution", f"""WITH {_SPLIT_SQL} SELECT 'all' AS part, label, count(*) AS n FROM split GROUP BY ALL
 UNION ALL SELECT split, label, count(*) FROM split GROUP BY ALL""")
def label_distribution(spark, sf_dir):
    return R.label_distribution(R.stratified_split(labelled(spark, sf_dir)))


@query("stratified_split", f"WITH {_SPLIT_SQL} SELECT message_id, label, split FROM split")
def stratified_split(spark, sf_dir):
    return R.stratified_split(labelled(spark, sf_dir)).select("message_id", "label", "split")


@query("stratified_kfold", f"WITH {_SPLIT_SQL} SELECT message_id, label, fold FROM split")
def stratified_kfold(spark, sf_dir):
    return R.with_folds(labelled(spark, sf_dir)).select("message_id", "label", "fold")


@query("sample_rows", f"WITH {MESSAGES_SQL} SELECT message_id, platform, risk_level FROM messages ORDER BY md5('42:' || message_id) LIMIT 5000")
def sample_rows(spark, sf_dir):
    return O.sample_n(messages(spark, sf_dir), 5000).select("message_id", "platform", "risk_level")


# --- evaluation ---
def _rate_sql(col):
    return f"""SELECT '{col}' AS col, {col} AS val, sum(CAST(true_label <> predicted AS INTEGER)) AS errors, count(*) AS total,
 CASE WHEN sum(CAST(true_label <> predicted AS INTEGER)) > 0 THEN round(sum(CAST(true_label <> predicted AS INTEGER)) / count(*), 6) END AS error_rate
 FROM preds GROUP BY {col}"""


@query("error_rate_by_group", f"WITH {PREDS_SQL} {_rate_sql('platform')} UNION ALL {_rate_sql('message_type')}")
def error_rate_by_group(spark, sf_dir):
    return tidy(ST.error_rate_of(preds(spark, sf_dir), ("platform", "message_type")))


COUNTS_SQL = """counts AS (SELECT count(*) FILTER (true_label = 0 AND predicted = 0) AS tn, count(*) FILTER (true_label = 0 AND predicted = 1) AS fp,
 count(*) FILTER (true_label = 1 AND predicted = 0) AS fn, count(*) FILTER (true_label = 1 AND predicted = 1) AS tp FROM preds)"""


@query("confusion_matrix", f"""WITH {PREDS_SQL}, {COUNTS_SQL} SELECT 0 AS true_label, tn AS pred_0, fp AS pred_1 FROM counts
 UNION ALL SELECT 1, fn, tp FROM counts""")
def confusion_matrix(spark, sf_dir):
    return ST.confusion_matrix(preds(spark, sf_dir))


def report_sql(keep: str = "") -> str:
    """Report rows from a relation `counts` with tn, fp, fn, tp (and the columns of `keep`)."""
    def d(a, b):
        return f"(CASE WHEN {b} = 0 THEN 0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"
    p0, r0, f0 = d("tn", "(tn + fn)"), d("tn", "(tn + fp)"), d("2 * tn", "(2 * tn + fn + fp)")
    p1, r1, f1 = d("tp", "(tp + fp)"), d("tp", "(tp + fn)"), d("2 * tp", "(2 * tp + fn + fp)")
    acc = d("tn + tp", "(tn + fp + fn + tp)")
    w = "((tn + fp) * {0} + (tp + fn) * {1}) / (tn + fp + fn + tp)"
    rows = [("0", p0, r0, f0, "tn + fp"), ("1", p1, r1, f1, "tp + fn"), ("accuracy", acc, acc, acc, "tn + fp + fn + tp"),
            ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", "tn + fp + fn + tp"),
            ("weighted avg", w.format(p0, p1), w.format(r0, r1), w.format(f0, f1), "tn + fp + fn + tp")]
    return " UNION ALL ".join(
        f"""SELECT {keep}'{n}' AS "class", round({p}, 6) AS "precision", round({r}, 6) AS recall, round({f}, 6) AS f1, {s} AS support FROM counts"""
        for n, p, r, f, s in rows)


@query("classification_report", f"WITH {PREDS_SQL}, {COUNTS_SQL} {report_sql()}")
def classification_report(spark, sf_dir):
    return tidy(ST.classification_report(preds(spark, sf_dir)))


_TCOUNTS = """counts AS (SELECT t AS threshold, count(*) FILTER (true_label = 0 AND probability < t) AS tn,
 count(*) FILTER (true_label = 0 AND probability >= t) AS fp, count(*) FILTER (true_label = 1 AND probability < t) AS fn,
 count(*) FILTER (true_label = 1 AND probability >= t) AS tp FROM preds, levels GROUP BY t)"""
_SWEEP_SQL = f"""{PREDS_SQL}, levels AS (SELECT CASE WHEN i = 99 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 99) END AS t FROM range(100) r(i)), {_TCOUNTS},
 pr AS (SELECT threshold, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM counts),
 sweep AS (SELECT threshold, p AS "precision", r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


@query("threshold_report", f"WITH {PREDS_SQL}, levels AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS t), {_TCOUNTS} {report_sql('threshold, ')}")
def threshold_report(spark, sf_dir):
    return tidy(ST.threshold_report(preds(spark, sf_dir)))


@query("threshold_sweep", f"""WITH {_SWEEP_SQL} SELECT round(threshold, 6) AS threshold, round("precision", 6) AS "precision",
 round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep""")
def threshold_sweep(spark, sf_dir):
    return tidy(ST.threshold_sweep(preds(spark, sf_dir)))


@query("optimal_thresholds", f"""WITH {_SWEEP_SQL} SELECT
 (SELECT round(min(threshold), 6) FROM sweep WHERE f1 = (SELECT max(f1) FROM sweep)) AS max_f1_threshold,
 (SELECT round(min(threshold), 6) FROM sweep WHERE "precision" >= 0.9) AS high_precision_threshold,
 (SELECT round(max(threshold), 6) FROM sweep WHERE recall >= 0.9) AS high_recall_threshold""")
def optimal_thresholds(spark, sf_dir):
    return tidy(ST.optimal_thresholds(ST.threshold_sweep(preds(spark, sf_dir))))


_CUM_SQL = f"""{PREDS_SQL}, by_score AS (SELECT probability AS p, count(*) FILTER (true_label = 1) AS pos, count(*) FILTER (true_label = 0) AS neg
   FROM preds GROUP BY probability),
 cum AS (SELECT p, pos, neg, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg, sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg
   FROM by_score WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""


@query("roc_auc", f"WITH {_CUM_SQL} SELECT round(sum(neg * (cpos - pos / 2)) / (max(tpos) * max(tneg)), 6) AS roc_auc FROM cum")
def roc_auc(spark, sf_dir):
    return tidy(ST.roc_auc(preds(spark, sf_dir)))


@query("roc_curve", f"""WITH {_CUM_SQL} SELECT round(p, 6) AS threshold, round(cneg / tneg, 6) AS fpr, round(cpos / tpos, 6) AS tpr FROM cum
 UNION ALL SELECT NULL, 0, 0""")
def roc_curve(spark, sf_dir):
    return tidy(ST.roc_curve(preds(spark, sf_dir)))


@query("pr_curve", f"""WITH {_CUM_SQL} SELECT round(p, 6) AS threshold, round(cpos / (cpos + cneg), 6) AS "precision", round(cpos / tpos, 6) AS recall FROM cum
 UNION ALL SELECT NULL, 1, 0""")
def pr_curve(spark, sf_dir):
    return tidy(ST.pr_curve(preds(spark, sf_dir)))


@query("accuracy", f"""WITH {PREDS_SQL} SELECT round(avg(CAST(true_label = predicted AS INTEGER)), 6) AS accuracy FROM preds""")
def accuracy(spark, sf_dir):
    return tidy(ST.accuracy(preds(spark, sf_dir)))


_EXPECT = ", ".join(f"({quote(t)}, {int(r == 'high')})" for t, r in PHRASES[:14])


@query("example_hit_rate", f"""WITH {PREDS_SQL}, ex(message_text, expected) AS (VALUES {_EXPECT}),
 j AS (SELECT expected, CASE WHEN probability >= 0.4 THEN 1 ELSE 0 END AS got FROM preds JOIN ex USING (message_text))
 SELECT count(*) AS n, sum(CAST(got = expected AS INTEGER)) AS correct, round(avg(CAST(got = expected AS INTEGER)), 6) AS hit_rate FROM j""")
def example_hit_rate(spark, sf_dir):
    """Hit rate over all messages that carry one of the 14 labelled example texts."""
    rows = [(t, int(r == "high")) for t, r in PHRASES[:14]]
    expected = spark.createDataFrame(rows, "message_text string, expected int")
    return tidy(ST.hit_rate(preds(spark, sf_dir).join(F.broadcast(expected), "message_text")))


@query("risk_split", f"""WITH {PREDS_SQL} SELECT {BAND_SQL} AS band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM preds GROUP BY 1""")
def risk_split(spark, sf_dir):
    banded = preds(spark, sf_dir).select(X.risk_band(F.col("probability")).alias("risk_level"))
    return tidy(ST.risk_split(banded))


_CORR = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS r FROM (SELECT CAST({V1[n]} AS DOUBLE) AS x, label::DOUBLE AS y FROM lab)"
    for n in E.V1_NAMES)


@query("feature_label_correlation", f"WITH {EXT_SQL}, lab AS (SELECT *, CASE WHEN risk_level IN ('high', 'medium') THEN 1 ELSE 0 END AS label FROM ext) {_CORR}")
def feature_label_correlation(spark, sf_dir):
    feats = E.numeric(E.features_v1(labelled(spark, sf_dir)), [*E.V1_NAMES, "label"])
    return tidy(ST.label_correlation(feats, E.V1_NAMES, "label"))


@query("class_balance_weight", f"""WITH {LABELLED_SQL}, c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled GROUP BY label)
 SELECT label, n, round(total / (2 * n), 6) AS balanced,
  round(CASE WHEN label = 1 THEN (total - n) / n ELSE 1 END, 6) AS scale_pos FROM c""")
def class_balance_weight(spark, sf_dir):
    rows = ST.with_class_weight(labelled(spark, sf_dir), "balanced", out="balanced")
    rows = ST.with_class_weight(rows, "scale_pos", out="scale_pos")
    return tidy(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("balanced").alias("balanced"), F.avg("scale_pos").alias("scale_pos")))


@query("standardize", f"""WITH {EXT_SQL}, v AS (SELECT message_id, length(txt)::DOUBLE AS msg_length, len(words)::DOUBLE AS word_count, len(sl)::DOUBLE AS total_slang FROM ext),
 s AS (SELECT avg(msg_length) m1, stddev_pop(msg_length) s1, avg(word_count) m2, stddev_pop(word_count) s2, avg(total_slang) m3, stddev_pop(total_slang) s3 FROM v)
 SELECT message_id, round((msg_length - m1) / s1, 6) + 0.0 AS msg_length, round((word_count - m2) / s2, 6) + 0.0 AS word_count,
  round((total_slang - m3) / s3, 6) + 0.0 AS total_slang, round(msg_length / s1, 6) AS msg_length_scaled FROM v, s""")
def standardize(spark, sf_dir):
    cols = ["msg_length", "word_count", "total_slang"]
    feats = E.numeric(E.features_v2(messages(spark, sf_dir)).withColumns({
        "msg_length": F.round(F.col("msg_length_norm") * 100), "word_count": F.size(X.tokens(X.text_or_empty(F.col("message_text"))))}), cols)
    stats = ST.scale_stats(feats, cols)
    scaled = feats.select("message_id", *cols, F.col("msg_length").alias("msg_length_scaled"))
    out = ST.standardize(scaled, cols, stats=stats)
    return tidy(ST.standardize(out, ["msg_length_scaled"], with_mean=False, stats={"msg_length_scaled": stats["msg_length"]}))


@query("latency_summary", """SELECT round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms, round(avg(value), 6) AS mean_ms,
 round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, avg(value) < 1.0 AS passes FROM events""")
def latency_summary(spark, sf_dir):
    return tidy(ST.latency_summary(table(spark, sf_dir, "events"), "value"))


@query("latency_summary_by_type", """SELECT event_type, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms, round(avg(value), 6) AS mean_ms,
 round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, avg(value) < 1.0 AS passes FROM events GROUP BY event_type""")
def latency_summary_by_type(spark, sf_dir):
    return tidy(ST.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"]))


_REQ_SQL = f"""{PREDS_SQL}, reqs AS (SELECT message_id // 10 AS request_id, min(ts) AS ts, count(*) AS n_messages,
   sum(CAST(probability >= 0.7 AS INTEGER)) AS n_flagged, bool_or(message_text IS NULL) AS is_error FROM preds GROUP BY 1)"""


def requests(spark, sf_dir):
    """Batches of ten messages as request rows; a batch with a missing text counts as an error."""
    flagged = (X.risk_band(F.col("probability")) == "High").cast("int")
    return scored(spark, sf_dir).groupBy(F.floor(F.col("message_id") / 10).alias("request_id")).agg(
        F.min("ts").alias("ts"), F.count("*").alias("n_messages"), F.sum(flagged).alias("n_flagged"),
        F.bool_or(F.col("message_text").isNull()).alias("is_error"))


@query("traffic_totals", f"""WITH {_REQ_SQL} SELECT count(*) AS requests, sum(n_messages) AS messages, sum(n_flagged) AS flagged,
 sum(CAST(is_error AS INTEGER)) AS errors, round(sum(n_flagged) * 100.0::DOUBLE / sum(n_messages), 6) AS flagged_pct,
 round(sum(n_messages) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS messages_per_sec FROM reqs""")
def traffic_totals(spark, sf_dir):
    return tidy(ST.traffic_totals(requests(spark, sf_dir)))


# --- windows ---
@query("running_analysis_count", f"""WITH {MESSAGES_SQL} SELECT message_id, sender_id,
 count(*) OVER (PARTITION BY sender_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) AS running_count FROM messages""")
def running_analysis_count(spark, sf_dir):
    out = O.running_count(messages(spark, sf_dir), ["sender_id"], "ts", F.date_trunc("hour", "ts"), "message_id")
    return out.select("message_id", "sender_id", "running_count")


@query("running_turn_count", """SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS running_count
 FROM conversations""")
def running_turn_count(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    out = O.running_count(turns, ["conv_id"], "turn", F.floor(F.col("turn") / 1000), "turn")
    return out.select("conv_id", "turn", "role", "running_count")


@query("last_n_samples", f"""WITH {PREDS_SQL} SELECT message_id, sender_id, left(message_text, 48) AS msg, round(probability, 6) AS score,
 {BAND_SQL} AS risk, latency_ms FROM preds ORDER BY ts DESC, message_id DESC LIMIT 6""")
def last_n_samples(spark, sf_dir):
    rows = O.last_n(scored(spark, sf_dir), 6)
    return tidy(rows.select("message_id", "sender_id", X.preview(F.col("message_text"), 48).alias("msg"),
                            F.col("probability").alias("score"), X.risk_band(F.col("probability")).alias("risk"), "latency_ms"))


# --- top-k ---
@query("top_false_positives", f"""WITH {PREDS_SQL} SELECT message_id, platform, message_type, message_text, round(probability, 6) AS probability
 FROM preds WHERE true_label = 0 AND predicted = 1 ORDER BY preds.probability DESC, message_id LIMIT 5""")
def top_false_positives(spark, sf_dir):
    return tidy(R.top_errors(preds(spark, sf_dir), "fp").select("message_id", "platform", "message_type", "message_text", "probability"))


@query("top_false_negatives", f"""WITH {PREDS_SQL} SELECT message_id, platform, message_type, message_text, round(probability, 6) AS probability
 FROM preds WHERE true_label = 1 AND predicted = 0 ORDER BY preds.probability, message_id LIMIT 5""")
def top_false_negatives(spark, sf_dir):
    return tidy(R.top_errors(preds(spark, sf_dir), "fn").select("message_id", "platform", "message_type", "message_text", "probability"))


# --- explanation ---
_MEANS = ", ".join(f"avg(CAST({c} AS INTEGER)) AS m_{c}" for c in EX.SCORE_WEIGHTS)
_BASE = " + ".join(f"{w} * m_{c}" for c, w in EX.SCORE_WEIGHTS.items())
_CONTRIB = " UNION ALL ".join(
    f"SELECT message_id, {_BASE} AS base, '{c}' AS feature, "
    + (f"{EX.SCORE_WEIGHTS[c]} * (CAST({c} AS INTEGER) - m_{c})" if c in EX.SCORE_WEIGHTS else "0::DOUBLE")
    + " AS contribution FROM features, means" for c in FE.FEATURE_NAMES)
_EXPLAIN_SQL = f"{FEATURES_SQL}, means AS (SELECT {_MEANS} FROM features), contrib AS ({_CONTRIB})"


@query("explain_linear_score", f"WITH {_EXPLAIN_SQL} SELECT message_id, round(base, 6) AS base, feature, round(contribution, 6) + 0.0 AS contribution FROM contrib")
def explain_linear_score(spark, sf_dir):
    return tidy(EX.explain_score(FE.final_features(messages(spark, sf_dir))))


@query("top_contributions", f"""WITH {_EXPLAIN_SQL}, r AS (SELECT message_id, feature, contribution,
  row_number() OVER (PARTITION BY message_id ORDER BY abs(round(contribution, 9)) DESC, feature) AS rank FROM contrib)
 SELECT message_id, rank, feature, round(contribution, 6) + 0.0 AS contribution FROM r WHERE rank <= 10""")
def top_contributions(spark, sf_dir):
    flags = FE.final_features(messages(spark, sf_dir)).select("message_id", *EX.SCORE_WEIGHTS)
    flags = materialize(flags, "flags")  # the texts are read once, for the means and the rows
    return tidy(EX.top_contributions(EX.contributions(flags, digits=9)))


_COLS = list(EX.SCORE_WEIGHTS)
_PERM_CTES = f"""{PREDS_SQL}, smp AS MATERIALIZED (SELECT message_id, true_label, weighted_risk_score, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in _COLS)}
   FROM preds),
 lft AS (SELECT *, row_number() OVER (ORDER BY md5('rows:' || message_id), message_id) AS rk FROM smp),
 reps AS (SELECT unnest([1, 2, 3, 4, 5]) AS rep),
 don AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY md5('rep' || rep || ':' || message_id), message_id) AS rk,
   {', '.join(f'{c} AS d_{c}' for c in _COLS)} FROM smp, reps),
 prd AS (SELECT * FROM lft JOIN don USING (rk)),
 acc AS (SELECT rep, avg(CAST(CAST(weighted_risk_score / 57.0::DOUBLE >= 0.5 AS INTEGER) = true_label AS INTEGER)) AS base,
   {', '.join(f'avg(CAST(CAST((weighted_risk_score + {EX.SCORE_WEIGHTS[c]} * (d_{c} - {c})) / 57.0::DOUBLE >= 0.5 AS INTEGER) = true_label AS INTEGER)) AS a_{c}' for c in _COLS)}
   FROM prd GROUP BY rep)"""
_PERM = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(base - a_{c}), 6) + 0.0 AS importance_mean, round(stddev_pop(base - a_{c}), 6) AS importance_std FROM acc" for c in _COLS)


@query("permutation_importance", f"WITH {_PERM_CTES} {_PERM}")
def permutation_importance(spark, sf_dir):
    return tidy(EX.rule_importance(scored(spark, sf_dir)))


@query("top_importances", f"WITH {_PERM_CTES}, imp AS ({_PERM}) SELECT feature, importance_mean AS importance FROM imp ORDER BY importance DESC, feature LIMIT 10")
def top_importances(spark, sf_dir):
    imp = EX.rule_importance(scored(spark, sf_dir)).select("feature", F.col("importance_mean").alias("importance"))
    return R.top_importances(tidy(imp), 10)
