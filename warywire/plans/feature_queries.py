"""Registered queries: production features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import features as FE
from .inputs import MESSAGES_SQL, PARTS_SQL, messages, sql_in, table
from .registry import query, tidy


def words_rx(words) -> str:
    return "|".join(words).replace("'", "''")


def flag_sql(c: str, rx: str) -> str:
    return f"regexp_matches({c}, '{rx}')"


SLANG_IN = sql_in(V.slang_terms())
FEATURE_SQL = {
    "emoji_count": "len(emo)",
    "drug_emoji_count": f"len(list_filter(emo, lambda e: e IN {sql_in(V.DRUG_EMOJIS)}))",
    "has_drug_emoji": f"len(list_filter(emo, lambda e: e IN {sql_in(V.DRUG_EMOJIS)})) > 0",
    "drug_emoji_ratio": f"round(len(list_filter(emo, lambda e: e IN {sql_in(V.DRUG_EMOJIS)})) / greatest(len(emo), 1), 6)",
    "slang_count": f"len(list_filter(words, lambda w: w IN {SLANG_IN}))",
    "has_slang": f"len(list_filter(words, lambda w: w IN {SLANG_IN})) > 0",
    "slang_ratio": f"round(len(list_filter(words, lambda w: w IN {SLANG_IN})) / greatest(len(words), 1), 6)",
    "char_count": "length(txt)",
    "word_count": "len(words)",
    "avg_word_length": "CASE WHEN len(words) = 0 THEN 0.0 ELSE round(list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / len(words), 6) END",
    "has_price": flag_sql("low", V.PRICE_RX),
    "has_quantity": flag_sql("low", V.QUANTITY_RX),
    "has_location": flag_sql("low", words_rx(V.LOCATION) + "|" + V.LOCATION_RX),
    "has_urgency": flag_sql("low", words_rx(V.URGENCY)),
    "has_discretion": flag_sql("low", words_rx(V.DISCRETION)),
    "has_quality": flag_sql("low", words_rx(V.QUALITY)),
    "has_transaction": flag_sql("low", words_rx(V.TRANSACTION)),
    "has_payment": flag_sql("low", words_rx(V.PAYMENT)),
    "has_time": flag_sql("low", words_rx(V.TIME)),
    "text_complexity": "round(len(list_distinct(words)) / greatest(len(words), 1), 6)",
    "has_punctuation": flag_sql("txt", "[.!?]"),
    "has_capitalization": flag_sql("txt", "[A-Z]"),
    "has_question": "contains(txt, '?')",
    "has_exclamation": "contains(txt, '!')",
    "has_normal_greeting": flag_sql("low", words_rx(V.GREETING)),
}
COMBO_SQL = {name: f"({a} AND {b})" for name, (a, b, _) in V.COMBOS.items()}
SCORE_SQL = " + ".join(
    [f"{w} * CAST({f} AS INTEGER)" for f, w in V.FLAG_WEIGHTS.items()]
    + [f"{w} * CAST({c} AS INTEGER)" for c, (_, _, w) in V.COMBOS.items()]
)
BASE_COLS = ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())
COMBO_COLS = ", ".join(f"{e} AS {n}" for n, e in COMBO_SQL.items())

# a chain of CTEs ending in `features`: all message columns and the 34 features
FEATURES_SQL = f"""{MESSAGES_SQL}, {PARTS_SQL},
base AS (SELECT * EXCLUDE (txt, low, words, emo), {BASE_COLS} FROM parts),
combos AS (SELECT *, {COMBO_COLS} FROM base),
scored AS (SELECT *, {SCORE_SQL} AS weighted_risk_score FROM combos),
features AS MATERIALIZED (SELECT *, CASE WHEN weighted_risk_score >= 8 THEN 'HIGH' WHEN weighted_risk_score >= 4
  THEN 'MEDIUM' ELSE 'LOW' END AS risk_category FROM scored)"""


def group_sql(names) -> str:
    cols = ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in names)
    return f"WITH {MESSAGES_SQL}, {PARTS_SQL} SELECT message_id, {cols} FROM parts"


GROUPS = {
    "emoji_features": (FE.emoji_features, ("emoji_count", "drug_emoji_count", "has_drug_emoji", "drug_emoji_ratio")),
    "slang_features": (FE.slang_features, ("slang_count", "has_slang", "slang_ratio")),
    "text_metrics": (FE.text_metrics, ("char_count", "word_count", "avg_word_length", "text_complexity")),
    "has_price": (FE.has_price, ("has_price",)),
    "has_quantity": (FE.has_quantity, ("has_quantity",)),
    "has_location": (FE.has_location, ("has_location",)),
    "has_urgency": (FE.has_urgency, ("has_urgency",)),
    "has_discretion": (FE.has_discretion, ("has_discretion",)),
    "has_quality": (FE.has_quality, ("has_quality",)),
    "has_transaction": (FE.has_transaction, ("has_transaction",)),
    "has_payment": (FE.has_payment, ("has_payment",)),
    "has_time": (FE.has_time, ("has_time",)),
    "style_flags": (FE.style_flags, ("has_punctuation", "has_capitalization", "has_question", "has_exclamation")),
    "has_normal_greeting": (FE.has_normal_greeting, ("has_normal_greeting",)),
}


def _register_group(name, fn, names):
    @query(name, group_sql(names))
    def run(spark, sf_dir):
        return tidy(fn(messages(spark, sf_dir)).select("message_id", *names))


for _name, (_fn, _names) in GROUPS.items():
    _register_group(_name, _fn, _names)


@query("suspicious_combos", f"WITH {FEATURES_SQL} SELECT message_id, {', '.join(V.COMBOS)} FROM features")
def suspicious_combos(spark, sf_dir):
    return FE.suspicious_combos(messages(spark, sf_dir)).select("message_id", *V.COMBOS)


@query("weighted_risk_score", f"WITH {FEATURES_SQL} SELECT message_id, weighted_risk_score FROM features")
def weighted_risk_score(spark, sf_dir):
    return FE.weighted_risk_score(messages(spark, sf_dir)).select("message_id", "weighted_risk_score")


@query("risk_category", f"WITH {FEATURES_SQL} SELECT message_id, weighted_risk_score, risk_category FROM features")
def risk_category(spark, sf_dir):
    scored = FE.weighted_risk_score(messages(spark, sf_dir))
    return scored.select("message_id", "weighted_risk_score",
                         X.risk_category(F.col("weighted_risk_score")).alias("risk_category"))


@query("final_features", f"WITH {FEATURES_SQL} SELECT message_id, {', '.join(FE.FEATURE_NAMES)} FROM features")
def final_features(spark, sf_dir):
    return tidy(FE.final_features(messages(spark, sf_dir)).select("message_id", *FE.FEATURE_NAMES))


_DOCS_SQL = FEATURES_SQL.replace(MESSAGES_SQL, "messages AS (SELECT doc_id AS message_id, text AS message_text FROM documents)")


@query("final_features_documents", f"WITH {_DOCS_SQL} SELECT message_id, {', '.join(FE.FEATURE_NAMES)} FROM features")
def final_features_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), F.col("text").alias("message_text"))
    return tidy(FE.final_features(docs).select("message_id", *FE.FEATURE_NAMES))


@query("feature_assemble_join",
       f"WITH {FEATURES_SQL} SELECT message_id, platform, message_type, message_text, {', '.join(FE.FEATURE_NAMES)} FROM features")
def feature_assemble_join(spark, sf_dir):
    out = FE.with_features(messages(spark, sf_dir))
    return tidy(out.select("message_id", "platform", "message_type", "message_text", *FE.FEATURE_NAMES))


@query("risk_category_by_platform",
       f"WITH {FEATURES_SQL} SELECT platform, risk_category, count(*) AS messages FROM features GROUP BY ALL")
def risk_category_by_platform(spark, sf_dir):
    scored = FE.final_features(messages(spark, sf_dir))
    return scored.groupBy("platform", "risk_category").agg(F.count("*").alias("messages"))
