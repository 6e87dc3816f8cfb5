"""Aggregates, evaluation metrics and curves over predictions.

Predictions carry ``true_label`` (0/1), ``predicted`` (0/1) and ``probability``. Every
metric is a few conditional sums over one pass, or a running total over distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import quantiles, running_totals

Y, YHAT, P = "true_label", "predicted", "probability"


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# --- distributions ---
def error_rate_by(preds: DataFrame, col: str) -> DataFrame:
    """Errors / total per group, highest first; a group without errors has null, not 0."""
    out = preds.groupBy(col).agg(
        F.sum((F.col(Y) != F.col(YHAT)).cast("long")).alias("errors"), F.count("*").alias("total"))
    rate = F.when(F.col("errors") > 0, F.col("errors") / F.col("total"))
    return out.withColumn("error_rate", rate).orderBy(F.col("error_rate").desc_nulls_last(), col)


def error_rate_of(preds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col, val, errors, total, error_rate) of the groups of several columns, counted in one pass."""
    wrong = (F.col(Y) != F.col(YHAT)).cast("long").alias("wrong")
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val"), wrong) for c in cols])
    out = preds.select(F.inline(pairs)).groupBy("col", "val").agg(F.sum("wrong").alias("errors"), F.count("*").alias("total"))
    return out.withColumn("error_rate", F.when(F.col("errors") > 0, F.col("errors") / F.col("total")))


def risk_split(scored: DataFrame, band: str = "risk_level") -> DataFrame:
    """Count and share of each band. The share is taken over the few band rows."""
    counts = scored.groupBy(F.col(band).alias("band")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def latency_summary(df: DataFrame, col: str = "ms", by: Sequence[str] = (), limit_ms: float = 1.0) -> DataFrame:
    """min, max, mean, median, p95 and whether the mean is below the limit."""
    base = df.groupBy(*by).agg(
        F.min(col).alias("min_ms"), F.max(col).alias("max_ms"), F.avg(col).alias("mean_ms"))
    places = quantiles(df, col, {"median_ms": 0.5, "p95_ms": 0.95}, by)
    if by:
        out = base.join(places, list(by))
    else:  # one row each
        out = base.withColumn("_k", F.lit(1)).join(places.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumn("passes", F.col("mean_ms") < limit_ms)


def traffic_totals(requests: DataFrame) -> DataFrame:
    """Totals over request rows (ts, n_messages, n_flagged, is_error)."""
    span = F.greatest(
        F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp")), F.lit(1000)) / 1e6
    out = requests.agg(
        F.count("*").alias("requests"), F.sum("n_messages").alias("messages"),
        F.sum("n_flagged").alias("flagged"), F.sum(F.col("is_error").cast("long")).alias("errors"),
        span.alias("_span"))
    return out.select(
        "requests", "messages", "flagged", "errors",
        (F.col("flagged") * 100.0 / F.greatest("messages", F.lit(1))).alias("flagged_pct"),
        (F.col("messages") / F.col("_span")).alias("messages_per_sec"))


# --- confusion-based metrics ---
def _counts(preds: DataFrame) -> DataFrame:
    def hit(y: int, p: int) -> Column:
        return F.coalesce(F.sum(((F.col(Y) == y) & (F.col(YHAT) == p)).cast("long")), F.lit(0))

    return preds.agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    rows = F.array(
        F.struct(F.lit(0).alias(Y), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
        F.struct(F.lit(1).alias(Y), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")))
    return _counts(preds).select(F.inline(rows))


def _report(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p0, r0, p1, r1 = _div(tn, tn + fn), _div(tn, tn + fp), _div(tp, tp + fp), _div(tp, tp + fn)
    f0, f1 = _div(2 * tn, 2 * tn + fn + fp), _div(2 * tp, 2 * tp + fn + fp)
    s0, s1, n = tn + fp, tp + fn, tn + fp + fn + tp
    in0, in1 = (tn + fp + fn > 0).cast("int"), (tp + fp + fn > 0).cast("int")

    def row(name: str, p: Column, r: Column, f: Column, s: Column, shown: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), s.cast("long").alias("support"), shown.alias("_shown"))

    def macro(a: Column, b: Column) -> Column:
        return _div(a * in0 + b * in1, in0 + in1)

    def weighted(a: Column, b: Column) -> Column:
        return _div(a * s0 + b * s1, n)

    acc, yes = _div(tn + tp, n), F.lit(True)
    rows = F.array(
        row("0", p0, r0, f0, s0, in0 == 1), row("1", p1, r1, f1, s1, in1 == 1), row("accuracy", acc, acc, acc, n, yes),
        row("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), n, yes),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n, yes))
    return counts.select(*keep, F.inline(rows)).filter("_shown").drop("_shown")


def classification_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted rows."""
    return _report(_counts(preds))


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col(Y) == F.col(YHAT)).cast("double")).alias("accuracy"))


# --- thresholds ---
def linspace(n: int) -> list[float]:
    step = 1.0 / (n - 1)
    return [i * step for i in range(n - 1)] + [1.0]


def _threshold_counts(preds: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """tp, fp, tn, fn at each threshold from one histogram pass.

    Each row falls into the number of thresholds it reaches (the list is sorted first);
    counts at a threshold are then sums over at most len(thresholds) + 1 bins.
    """
    levels = sorted(set(float(t) for t in thresholds))
    # the score is bound once, as p, and compared with each level
    array = ", ".join(f"{t!r}D" for t in levels)
    reached = F.expr(f"transform(array({P}), p -> size(filter(array({array}), t -> t <= p)))[0]")
    # never null, so the join below infers no null filter that would repeat the scoring expressions
    hist = preds.groupBy(F.coalesce(reached, F.lit(0)).alias("bin")).agg(
        F.sum((F.col(Y) == 1).cast("long")).alias("pos"), F.sum((F.col(Y) == 0).cast("long")).alias("neg"))
    axis = preds.sparkSession.createDataFrame([(0, None)] + [(i + 1, t) for i, t in enumerate(levels)], "bin int, threshold double")
    full = axis.join(hist, "bin", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = full.select(
        "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"))
    return out.filter(F.col("threshold").isNotNull()).select(
        "threshold", "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn"))


def threshold_report(preds: DataFrame, thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """The classification report at each threshold, from one pass over the predictions."""
    return _report(_threshold_counts(preds, thresholds), ["threshold"])


def threshold_sweep(preds: DataFrame, n: int = 100) -> DataFrame:
    """Precision, recall and F1 at n evenly spaced thresholds in [0, 1]."""
    c = _threshold_counts(preds, linspace(n))
    p, r = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("threshold", p.alias("precision"), r.alias("recall"), _div(2 * p * r, p + r).alias("f1"))


def optimal_thresholds(sweep: DataFrame, floor: float = 0.9) -> DataFrame:
    """First threshold of the best F1, first with precision >= floor, last with recall >= floor
    (null when no threshold reaches the floor)."""
    best = F.min(F.struct((-F.col("f1")).alias("f"), F.col("threshold").alias("t")))
    return sweep.agg(
        best["t"].alias("max_f1_threshold"),
        F.min(F.when(F.col("precision") >= floor, F.col("threshold"))).alias("high_precision_threshold"),
        F.max(F.when(F.col("recall") >= floor, F.col("threshold"))).alias("high_recall_threshold"))


# --- ranking metrics ---
def _by_score(preds: DataFrame) -> DataFrame:
    """Distinct scores from high to low with running positives and negatives."""
    scores = preds.groupBy(P).agg(
        F.sum((F.col(Y) == 1).cast("long")).alias("pos"), F.sum((F.col(Y) == 0).cast("long")).alias("neg"))
    return running_totals(scores, [P], ["pos", "neg"], descending=True)


def roc_auc(preds: DataFrame) -> DataFrame:
    """Area under the ROC curve, tied scores counted half; null with one class only."""
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
    return _by_score(preds).agg(F.try_divide(area, F.when(pairs > 0, pairs)).alias("roc_auc"))


def roc_curve(preds: DataFrame) -> DataFrame:
    """One point per distinct score; the start point (0, 0) has a null threshold."""
    points = _by_score(preds).select(
        F.col(P).alias("threshold"), F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))
    start = preds.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(start)


def pr_curve(preds: DataFrame) -> DataFrame:
    """Precision and recall per distinct score; the end point (1, 0) has a null threshold."""
    points = _by_score(preds).select(
        F.col(P).alias("threshold"),
        _div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("recall"))
    end = preds.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


# --- feature statistics ---
def label_correlation(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Pearson r of each numeric column with the label, highest first; null without variance."""
    def r(c: str) -> Column:
        spread = F.stddev_pop(c) * F.stddev_pop(label)
        return F.try_divide(F.covar_pop(c, label), spread).alias(c)

    one = df.agg(*[r(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "r").orderBy(F.col("r").desc_nulls_last(), "feature")


def class_counts(df: DataFrame, label: str = "label", max_classes: int = 1000) -> dict:
    """Rows per class, on the driver; refuses labels with more than ``max_classes`` values."""
    rows = df.groupBy(label).count().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} values")
    return {r[0]: r[1] for r in rows}


def with_class_weight(df: DataFrame, mode: str = "balanced", label: str = "label", out: str = "weight") -> DataFrame:
    """Adds a weight column: n / (classes * n_class), or negatives / max(positives, 1) on positives."""
    counts = class_counts(df, label)
    if mode == "scale_pos":
        ratio = (sum(counts.values()) - counts.get(1, 0)) / max(counts.get(1, 0), 1)
        return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(1.0))
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        share = sum(counts.values()) / (len(counts) * n)
        weight = F.when(F.col(label).eqNullSafe(F.lit(value)), share).otherwise(weight)
    return df.withColumn(out, weight)


def scale_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (1 where the deviation is 0), on the driver."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def standardize(df: DataFrame, cols: Sequence[str], with_mean: bool = True,
                stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """z-scores. Fit on training rows with ``scale_stats`` and pass the result to apply it elsewhere."""
    stats = stats or scale_stats(df, cols)
    return df.withColumns({
        c: (F.col(c) - (stats[c][0] if with_mean else 0.0)) / F.lit(stats[c][1]) for c in cols})


def hit_rate(preds: DataFrame, expected: str = "expected", t: float = 0.4) -> DataFrame:
    """Share of labelled examples whose decision at ``t`` meets the expectation."""
    ok = X.apply_threshold(F.col(P), t) == F.col(expected)
    return preds.agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("correct"), F.avg(ok.cast("double")).alias("hit_rate"))
