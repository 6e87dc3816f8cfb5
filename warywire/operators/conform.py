"""Projections, predicates and unions that bring sources to one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

COLUMNS = ("platform", "message_type", "message_text", "risk_level")


def conform_source(df: DataFrame) -> DataFrame:
    """Any source with ``message`` or ``text``, ``suspicious`` and perhaps ``platform``,
    as the four message columns. Decided from the schema alone."""
    text = next((F.col(c) for c in ("message", "text") if c in df.columns), F.lit(""))
    platform = F.col("platform") if "platform" in df.columns else F.lit("Telegram")
    return df.select(
        platform.alias("platform"),
        F.lit("general").alias("message_type"),
        text.alias("message_text"),
        X.risk_from_flag(F.col("suspicious")).alias("risk_level"),
    )


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def append_negatives(df: DataFrame, n: int = 1000) -> DataFrame:
    """Add n generated harmless rows, unless the union is empty."""
    if df.isEmpty():
        return df
    step = (F.col("id") % len(V.NEGATIVE_TEXTS) + 1).cast("int")
    extra = df.sparkSession.range(n).select(
        F.element_at(F.array(*map(F.lit, V.NEGATIVE_PLATFORMS)), step).alias("platform"),
        F.lit("general").alias("message_type"),
        F.element_at(F.array(*map(F.lit, V.NEGATIVE_TEXTS)), step).alias("message_text"),
        F.lit("low").alias("risk_level"),
    )
    return df.unionByName(extra)


def with_scoring_defaults(df: DataFrame) -> DataFrame:
    """Adds the default platform and message type where the column is missing; given values stay."""
    defaults = {"platform": "Telegram", "message_type": "general"}
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def drop_blank(df: DataFrame, text_col: str = "message_text") -> DataFrame:
    """Normalise the text and drop rows that are empty afterwards."""
    return df.withColumn(text_col, X.normalize_text(F.col(text_col))).filter(F.length(text_col) > 0)


def validate_messages(df: DataFrame, text_col: str = "message_text", max_chars: int = 10_000) -> DataFrame:
    """Adds is_valid and reason; the first failing check names the reason."""
    text = X.text_or_empty(F.col(text_col))
    reason = (
        F.when(~text.rlike(f"[^{V.SPACE}]"), V.BLANK_REASON)
        .when(F.length(text) > max_chars, V.LONG_REASON)
        .when(F.lower(text).rlike(V.UNSAFE_RX), V.UNSAFE_REASON)
        .otherwise("")
    )
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason") == "")


def with_actions(df: DataFrame, band: str = "risk_level") -> DataFrame:
    """Adds the recommended actions of a risk band."""
    pick: Column = F.array().cast("array<string>")
    for name, actions in V.ACTIONS.items():
        if actions:
            pick = F.when(F.col(band) == name, F.array(*map(F.lit, actions))).otherwise(pick)
    return df.withColumn("actions", pick)


def feature_details(df: DataFrame) -> DataFrame:
    """Adds the nested three-section view of the features; missing ones read as 0 or No."""
    def number(name: str, label: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)
        return value.alias(label)

    def yes_no(name: str, label: str) -> Column:
        flag = F.col(name) if name in df.columns else F.lit(False)
        return F.when(flag, "Yes").otherwise("No").alias(label)

    details = F.struct(
        F.struct(
            number("char_count", "Character Count"), number("word_count", "Word Count"),
            number("emoji_count", "Total Emojis"), number("drug_emoji_count", "Drug-Related Emojis"),
            number("slang_count", "Slang Words"),
        ).alias("Text Analysis"),
        F.struct(
            yes_no("has_price", "Price Patterns"), yes_no("has_quantity", "Quantity Patterns"),
            yes_no("has_location", "Location Indicators"), yes_no("has_urgency", "Urgency Indicators"),
        ).alias("Pattern Detection"),
        F.struct(
            yes_no("has_punctuation", "Has Punctuation"), yes_no("has_capitalization", "Has Capitalization"),
        ).alias("Text Characteristics"),
    )
    return df.withColumn("details", details)


def filter_metadata(df: DataFrame, platform: str | None = None, risk_level: str | None = None) -> DataFrame:
    """Optional equality on platform and risk_level, as plain filters that reach the scan."""
    if platform:
        df = df.filter(F.col("platform") == platform)
    if risk_level:
        df = df.filter(F.col("risk_level") == risk_level)
    return df


def misclassified(preds: DataFrame, kind: str, label: str = "true_label", predicted: str = "predicted") -> DataFrame:
    """False positives ('fp') or false negatives ('fn')."""
    want, got = {"fp": (0, 1), "fn": (1, 0)}[kind]
    return preds.filter((F.col(label) == want) & (F.col(predicted) == got))


def misclassified_rows(preds: DataFrame, label: str = "true_label", predicted: str = "predicted") -> DataFrame:
    """False positives and false negatives in one pass, named in ``kind``."""
    return preds.filter(F.col(label) != F.col(predicted)).withColumn("kind", F.when(F.col(predicted) == 1, "fp").otherwise("fn"))


def with_identity(df: DataFrame, text_col: str = "message_text") -> DataFrame:
    """Adds a deterministic id and the metadata map. The id depends on the row's own key and
    text, so a replayed batch writes the same ids instead of new ones."""
    unknown = {c: F.coalesce(F.col(c), F.lit("unknown")) if c in df.columns else F.lit("unknown")
               for c in ("platform", "risk_level")}
    ident = F.sha2(F.concat_ws("\x1f", F.col("message_id").cast("string"),
                               X.normalize_text(F.col(text_col))), 256)
    out = df.withColumn("id", ident)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss") if "ts" in df.columns else F.lit(None).cast("string")
    return out.withColumn("metadata", F.create_map(
        F.lit("platform"), unknown["platform"],
        F.lit("risk_level"), unknown["risk_level"],
        F.lit("message_id"), F.col("id"),
        F.lit("timestamp"), stamp,
    ))
