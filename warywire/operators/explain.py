"""Additive explanations of the rule score, and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..session import materialize
from .features import FEATURE_NAMES
from .ordered import hash_rank, sample_n

SCORE_WEIGHTS = {**V.FLAG_WEIGHTS, **{name: w for name, (_, _, w) in V.COMBOS.items()}}


def flag_means(features: DataFrame) -> dict[str, float]:
    """Mean of each weighted flag, on the driver (one number per flag)."""
    row = features.agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in SCORE_WEIGHTS]).first()
    return {c: row[c] or 0.0 for c in SCORE_WEIGHTS}


def contributions(features: DataFrame, means: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """Adds base and contributions: array<struct<feature, contribution>> in feature order.

    The rule score is linear in its flags, so w * (x - E[x]) is the exact additive
    explanation: contributions sum to score - base. Features outside the score get 0.
    A flag has two contributions, so both are computed (and rounded to ``digits``) in the plan, not in every row.
    """
    means = means or flag_means(features)

    def given(name: str, x: float) -> Column:
        value = F.lit((x - means[name]) * SCORE_WEIGHTS[name])
        return value if digits is None else F.round(value, digits)

    def one(name: str) -> Column:
        if name in SCORE_WEIGHTS:
            value = F.when(F.col(name), given(name, 1.0)).when(~F.col(name), given(name, 0.0))  # null stays null
        else:
            value = F.lit(0.0)
        return F.struct(F.lit(name).alias("feature"), value.alias("contribution"))

    base = sum(w * means[c] for c, w in SCORE_WEIGHTS.items())
    return features.withColumns({
        "base": F.lit(float(base)), "contributions": F.array(*[one(c) for c in FEATURE_NAMES])})


def explain_score(features: DataFrame, means: dict[str, float] | None = None) -> DataFrame:
    """Long form: (message_id, base, feature, contribution), one row per feature."""
    return contributions(features, means).select("message_id", "base", F.inline("contributions"))


def top_contributions(explained: DataFrame, n: int = 10) -> DataFrame:
    """The n features of largest absolute contribution per message.

    Sorted inside the row's own array, so the messages are not shuffled.
    """
    keyed = F.transform("contributions", lambda c: F.struct(
        (-F.abs(c["contribution"])).alias("k"), c["feature"].alias("feature"), c["contribution"].alias("contribution")))
    best = F.slice(F.sort_array(keyed), 1, n)  # the natural order in generated code; array_sort interprets a comparison
    return explained.select("message_id", F.posexplode(best).alias("pos", "c")).select(
        "message_id", (F.col("pos") + 1).alias("rank"), F.col("c.feature").alias("feature"),
        F.col("c.contribution").alias("contribution"))


Scorer = Callable[[DataFrame], DataFrame]


def rule_importance(features: DataFrame, label: str = "true_label", threshold: float = 0.5, repeats: int = 5,
                    max_rows: int | None = None, ident: str = "message_id") -> DataFrame:
    """Permutation importance of each flag for the rule model's accuracy.

    A permutation pairs the rows ranked by one hash with the same rows ranked by another.
    The score is linear in the flags, so replacing one flag moves it by w * (x' - x); one
    join per repeat serves all flags at once. Every row is used unless ``max_rows`` asks for a sample.
    """
    cols = list(SCORE_WEIGHTS)
    base = features.select(ident, label, "weighted_risk_score", *[F.col(c).cast("int").alias(c) for c in cols])
    if max_rows is not None:
        base = sample_n(base, max_rows, ident)
    base = materialize(base, "permutation")  # read once per repeat, scored once
    left = hash_rank(base, [], ident, "rows", rank="_rank", total="_n")
    reps = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep")
    left = left.select("*", reps)
    donors = None
    for rep in range(1, repeats + 1):
        part = hash_rank(base, [], ident, f"rep{rep}", rank="_rank", total="_n").select(
            "_rank", F.lit(rep).alias("rep"), *[F.col(c).alias(f"d_{c}") for c in cols])
        donors = part if donors is None else donors.unionByName(part)
    paired = left.join(donors, ["_rank", "rep"])

    def right(score: Column) -> Column:
        return F.avg(((score / float(V.MAX_SCORE) >= threshold).cast("int") == F.col(label)).cast("double"))

    score = F.col("weighted_risk_score")
    per_rep = paired.groupBy("rep").agg(
        right(score).alias("_base"),
        *[right(score + SCORE_WEIGHTS[c] * (F.col(f"d_{c}") - F.col(c))).alias(c) for c in cols])
    drops = per_rep.select("rep", *[(F.col("_base") - F.col(c)).alias(c) for c in cols])
    return drops.unpivot(["rep"], cols, "feature", "importance").groupBy("feature").agg(
        F.avg("importance").alias("importance_mean"), F.stddev_pop("importance").alias("importance_std"))


def permutation_importance(df: DataFrame, scorer: Scorer, groups: dict[str, Sequence[str]], repeats: int = 5,
                           max_rows: int | None = None, label: str = "label", ident: str = "message_id") -> DataFrame:
    """Mean and deviation of the accuracy drop when each group of input columns is permuted together across rows.

    ``scorer`` maps rows to rows with ``prediction``. The rows are ranked once; in a repeat each meets one donor, and all groups'
    variants are made of that one pair and scored together.
    """
    rows = materialize(df if max_rows is None else sample_n(df, max_rows, ident), "permutation")
    spark, moved = df.sparkSession, [c for group in groups.values() for c in group]
    left = materialize(hash_rank(rows, [], ident, "rows", rank="_rank", total="_n").drop("_n"), "permutation-rows")
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    base = scorer(rows).agg(right).first()[0]
    drops = []
    for rep in range(1, repeats + 1):
        donors = hash_rank(rows.select(ident, *dict.fromkeys(moved)), [], ident, f"rep{rep}", rank="_rank", total="_n").select(
            "_rank", *[F.col(c).alias(f"_d_{c}") for c in dict.fromkeys(moved)])
        paired = left.join(donors.hint("merge"), "_rank")  # written rows are small for their number: never broadcast
        variants = F.array(*[F.struct(F.lit(name).alias("feature"), *[F.col(f"_d_{c}" if c in group else c).alias(c) for c in rows.columns])
                             for name, group in groups.items()])
        hits = scorer(paired.select(F.inline(variants))).groupBy("feature").agg(right.alias("acc")).collect()  # one row for each group
        drops += [(r["feature"], rep, base - r["acc"]) for r in hits]
    return spark.createDataFrame(drops, "feature string, rep int, drop double").groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
