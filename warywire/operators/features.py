"""The 34 production features of a message.

Each group is a function from the prepared parts of a text to named columns; the
DataFrame functions add one group, ``final_features`` adds all. Lower-casing, token and
emoji extraction happen once, in an inner projection that Catalyst keeps separate
because the outer one refers to it many times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

PARTS = ("_text", "_low", "_words", "_emojis", "_drug", "_slang")


@dataclass(frozen=True)
class Parts:
    """The columns every feature is computed from."""

    text: Column
    low: Column
    words: Column
    emojis: Column
    drug: Column  # number of drug emojis
    hits: Column  # number of slang tokens
    slang: tuple[str, ...]


def prepare(df: DataFrame, text_col: str = "message_text", slang: Iterable[str] | None = None) -> DataFrame:
    """Adds the parts. What a query does not use is pruned from the plan."""
    terms = tuple(slang) if slang is not None else V.slang_terms()
    df = df.withColumn("_text", X.text_or_empty(F.col(text_col)))
    df = df.withColumn("_low", F.lower("_text"))
    df = df.withColumns({"_words": X.tokens(F.col("_low")), "_emojis": X.emojis(F.col("_text"))})
    return df.withColumns({
        "_drug": F.size(X.tokens_in("_emojis", V.DRUG_EMOJIS)),
        "_slang": F.size(X.tokens_in("_words", terms)),
    })


def parts(slang: Iterable[str] | None = None) -> Parts:
    terms = tuple(slang) if slang is not None else V.slang_terms()
    return Parts(*[F.col(c) for c in PARTS], terms)


Group = Callable[[Parts], dict[str, Column]]


def add(df: DataFrame, *groups: Group, text_col: str = "message_text",
        slang: Iterable[str] | None = None) -> DataFrame:
    """Add the columns of the given groups to ``df``."""
    p = parts(slang)
    columns: dict[str, Column] = {}
    for group in groups:
        columns.update(group(p))
    return prepare(df, text_col, slang).withColumns(columns).drop(*PARTS)


# --- groups ---
def emoji_group(p: Parts) -> dict[str, Column]:
    total = F.size(p.emojis)
    return {
        "emoji_count": total,
        "drug_emoji_count": p.drug,
        "has_drug_emoji": p.drug > 0,
        "drug_emoji_ratio": p.drug / F.greatest(total, F.lit(1)),
    }


def slang_group(p: Parts) -> dict[str, Column]:
    return {
        "slang_count": p.hits,
        "has_slang": p.hits > 0,
        "slang_ratio": p.hits / F.greatest(F.size(p.words), F.lit(1)),
    }


def metrics_group(p: Parts) -> dict[str, Column]:
    n = F.size(p.words)
    letters = F.aggregate(p.words, F.lit(0), lambda acc, w: acc + F.length(w))
    return {
        "char_count": F.length(p.text),
        "word_count": n,
        "avg_word_length": X.ratio(letters, n),
        "text_complexity": F.size(F.array_distinct(p.words)) / F.greatest(n, F.lit(1)),
    }


def price_group(p: Parts) -> dict[str, Column]:
    return {"has_price": p.low.rlike(V.PRICE_RX)}


def quantity_group(p: Parts) -> dict[str, Column]:
    return {"has_quantity": p.low.rlike(V.QUANTITY_RX)}


def location_group(p: Parts) -> dict[str, Column]:
    return {"has_location": X.any_substring("_low", V.LOCATION) | p.low.rlike(V.LOCATION_RX)}


def urgency_group(p: Parts) -> dict[str, Column]:
    return {"has_urgency": X.any_substring("_low", V.URGENCY)}


def discretion_group(p: Parts) -> dict[str, Column]:
    return {"has_discretion": X.any_substring("_low", V.DISCRETION)}


def quality_group(p: Parts) -> dict[str, Column]:
    return {"has_quality": X.any_substring("_low", V.QUALITY)}


def transaction_group(p: Parts) -> dict[str, Column]:
    return {"has_transaction": X.any_substring("_low", V.TRANSACTION)}


def payment_group(p: Parts) -> dict[str, Column]:
    return {"has_payment": X.any_substring("_low", V.PAYMENT)}


def time_group(p: Parts) -> dict[str, Column]:
    return {"has_time": X.any_substring("_low", V.TIME)}


def greeting_group(p: Parts) -> dict[str, Column]:
    return {"has_normal_greeting": X.any_substring("_low", V.GREETING)}


def style_group(p: Parts) -> dict[str, Column]:
    return {
        "has_punctuation": p.text.rlike("[.!?]"),
        "has_capitalization": p.text.rlike("[A-Z]"),
        "has_question": p.text.contains("?"),
        "has_exclamation": p.text.contains("!"),
    }


FLAG_GROUPS: tuple[Group, ...] = (
    price_group, quantity_group, location_group, urgency_group, discretion_group,
    quality_group, transaction_group, payment_group, time_group,
)
SCORED_GROUPS: tuple[Group, ...] = (
    emoji_group, slang_group, price_group, quantity_group, location_group, urgency_group,
    discretion_group, quality_group, transaction_group, payment_group,
)


def combo_columns() -> dict[str, Column]:
    return {name: F.col(a) & F.col(b) for name, (a, b, _) in V.COMBOS.items()}


def score_column() -> Column:
    terms = [F.col(flag).cast("int") * weight for flag, weight in V.FLAG_WEIGHTS.items()]
    terms += [F.col(name).cast("int") * weight for name, (_, _, weight) in V.COMBOS.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


# --- DataFrame functions, one per operator ---
def emoji_features(df: DataFrame) -> DataFrame:
    return add(df, emoji_group)


def slang_features(df: DataFrame, slang: Iterable[str] | None = None) -> DataFrame:
    return add(df, slang_group, slang=slang)


def text_metrics(df: DataFrame, text_col: str = "message_text") -> DataFrame:
    return add(df, metrics_group, text_col=text_col)


def has_price(df: DataFrame) -> DataFrame:
    return add(df, price_group)


def has_quantity(df: DataFrame) -> DataFrame:
    return add(df, quantity_group)


def has_location(df: DataFrame) -> DataFrame:
    return add(df, location_group)


def has_urgency(df: DataFrame) -> DataFrame:
    return add(df, urgency_group)


def has_discretion(df: DataFrame) -> DataFrame:
    return add(df, discretion_group)


def has_quality(df: DataFrame) -> DataFrame:
    return add(df, quality_group)


def has_transaction(df: DataFrame) -> DataFrame:
    return add(df, transaction_group)


def has_payment(df: DataFrame) -> DataFrame:
    return add(df, payment_group)


def has_time(df: DataFrame) -> DataFrame:
    return add(df, time_group)


def has_normal_greeting(df: DataFrame) -> DataFrame:
    return add(df, greeting_group)


def style_flags(df: DataFrame) -> DataFrame:
    return add(df, style_group)


def suspicious_combos(df: DataFrame, slang: Iterable[str] | None = None) -> DataFrame:
    return add(df, *SCORED_GROUPS, slang=slang).withColumns(combo_columns())


def weighted_risk_score(df: DataFrame, slang: Iterable[str] | None = None) -> DataFrame:
    return suspicious_combos(df, slang).withColumn("weighted_risk_score", score_column())


FEATURE_NAMES = (
    "emoji_count", "drug_emoji_count", "has_drug_emoji", "drug_emoji_ratio",
    "slang_count", "has_slang", "slang_ratio", "char_count", "word_count", "avg_word_length",
    "has_price", "has_quantity", "has_location", "has_urgency", "has_discretion", "has_quality",
    "has_transaction", "has_payment", "has_time", *V.COMBOS, "weighted_risk_score",
    "text_complexity", "has_punctuation", "has_capitalization", "has_question",
    "has_exclamation", "has_normal_greeting", "risk_category",
)
MODEL_FEATURES = FEATURE_NAMES[:-1]


def final_features(df: DataFrame, text_col: str = "message_text",
                   slang: Iterable[str] | None = None) -> DataFrame:
    """All input columns plus the 34 features, in their published order. No shuffle, no Python."""
    keep = df.columns
    groups = (emoji_group, slang_group, metrics_group, *FLAG_GROUPS, style_group, greeting_group)
    out = (
        add(df, *groups, text_col=text_col, slang=slang)
        .withColumns(combo_columns())
        .withColumn("weighted_risk_score", score_column())
        .withColumn("risk_category", X.risk_category(F.col("weighted_risk_score")))
    )
    return out.select(*keep, *FEATURE_NAMES)


with_features = final_features


def rule_probability(score: Column | None = None) -> Column:
    """The rule score as a fraction of its maximum: a deterministic probability."""
    return (score if score is not None else F.col("weighted_risk_score")) / float(V.MAX_SCORE)
