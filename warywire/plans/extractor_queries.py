"""Registered queries: notebook extractors and positional text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import extractors as E
from ..operators import features as FE
from ..operators import joins as J
from .feature_queries import PARTS_SQL, SLANG_IN, flag_sql, words_rx
from .inputs import MESSAGES_SQL, messages, sql_in, table
from .registry import query, tidy
from .source_queries import SLANG_SQL

_ALT = X.alternation(V.slang_terms()).replace(" ", "  ")
_EMO_ALT = X.alternation(V.emoji_terms())
# `ext`: parts plus slang positions (pos), slang tokens (sl), emoji and slang lexicon hits (eh, sh).
# Doubling every non-word character gives each hit its own boundary on either side.
EXT_SQL = f"""{MESSAGES_SQL}, {PARTS_SQL},
ext AS (SELECT *,
  list_filter(list_transform(words, lambda w, i: CASE WHEN w IN {SLANG_IN} THEN i END), lambda x: x IS NOT NULL) AS pos,
  list_filter(words, lambda w: w IN {SLANG_IN}) AS sl,
  regexp_extract_all(txt, '{_EMO_ALT}') AS eh,
  list_transform(regexp_extract_all(' ' || regexp_replace(low, '([^{V.WORD}])', '\\1\\1', 'g') || ' ',
    '[^{V.WORD}]({_ALT})[^{V.WORD}]', 1), lambda h: replace(h, '  ', ' ')) AS sh
  FROM parts)"""


def _gaps(c):
    return f"list_transform(range(1, len({c})), lambda i: {c}[i + 1] - {c}[i])"


def _in(words):
    return f"len(list_filter(words, lambda w: w IN {sql_in(words)})) > 0"


def _emo(values):
    return f"list_filter(emo, lambda e: e IN {sql_in(values)})"


def _density(rx):
    return f"CASE WHEN length(txt) = 0 THEN 0 ELSE round(len(regexp_extract_all(txt, '{rx}')) / length(txt), 6) END"


def _any(words):
    return flag_sql("low", words_rx(words))


AVG_WORD = "CASE WHEN len(words) = 0 THEN 0.0 ELSE round(list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / len(words), 6) END"
BASIC = {
    "msg_length": "length(txt)", "word_count": "len(words)", "avg_word_length": AVG_WORD,
    "question_marks": "len(regexp_extract_all(txt, '[?]'))", "exclamation_marks": "len(regexp_extract_all(txt, '!'))",
}
V1 = {
    "total_emojis": "len(emo)", "unique_emojis": "len(list_distinct(emo))",
    "suspicious_emoji_combos": f"len({_emo(V.V1_DRUG_EMOJIS)}) > 1",
    "urgent_time": _any(V.V1_URGENT_TIME), "late_hours": _any(V.V1_LATE_HOURS),
    "discrete_location": _any(V.V1_LOCATION), "precise_quantity": flag_sql("low", V.V1_QUANTITY_RX),
    "price_negotiation": flag_sql("low", words_rx(V.V1_PRICE) + "|" + V.V1_PRICE_RX),
    "urgency_tactics": _any(V.V1_URGENCY), "discretion_terms": _any(V.V1_DISCRETION),
    "quality_terms": _any(V.V1_QUALITY), "transaction_terms": _any(V.V1_TRANSACTION),
    "total_slang": "len(list_distinct(sl))", "unique_slang": "len(list_distinct(sl))",
    "slang_proximity": f"len(list_filter({_gaps('pos')}, lambda d: d <= 3)) > 0",
    **BASIC,
}
_PAIR = (f"len(list_filter(range(1, len(emo)), lambda i: (emo[i] IN {sql_in(V.V1_DRUG_EMOJIS)} AND emo[i + 1] IN {sql_in(V.V2_MONEY_EMOJIS)})"
         f" OR (emo[i] IN {sql_in(V.V2_MONEY_EMOJIS)} AND emo[i + 1] IN {sql_in(V.V1_DRUG_EMOJIS)}))) > 0")
_BI = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
_LATE = "coalesce(extract(hour FROM try_strptime(ts_text, '%m/%d/%Y %H:%M')) >= 22 OR extract(hour FROM try_strptime(ts_text, '%m/%d/%Y %H:%M')) <= 4, FALSE)"
_NCAT = "(SELECT count(DISTINCT category) FROM slang WHERE list_contains(sl, term))"
V2 = {
    "total_emojis": "len(emo)", "unique_emojis": "len(list_distinct(emo))",
    "drug_money_combo": f"len({_emo(V.V1_DRUG_EMOJIS)}) > 0 AND len({_emo(V.V2_MONEY_EMOJIS)}) > 0",
    "suspicious_sequence": _PAIR,
    "emoji_density": "CASE WHEN len(words) = 0 THEN 0 ELSE round(len(emo) / len(words), 6) END",
    "urgent_time": f"{_in(V.V2_TIME)} OR len(list_filter({_BI}, lambda b: b IN {sql_in(V.V2_TIME_PAIRS)})) > 0",
    "late_night": _LATE, "location_indicator": _in(V.V2_LOCATION), "discreet_location": _in(V.V2_DISCREET),
    "price_pattern": flag_sql("low", V.V2_PRICE_RX), "quantity_pattern": flag_sql("low", V.V2_QUANTITY_RX),
    "secure_platform": f"lower(platform) IN {sql_in(V.V2_SECURE_PLATFORMS)}", "msg_length_norm": "round(length(txt) / 100.0, 6)",
    "urgency_score": f"CASE WHEN len(words) = 0 THEN 0 ELSE round(len(list_filter(words, lambda w: w IN {sql_in(V.V2_URGENCY)})) / len(words), 6) END",
    "discretion_indicator": _in(V.V2_DISCRETION), "quality_indicator": _in(V.V2_QUALITY),
    "transaction_pattern": _in(V.V2_TRANSACTION), "trust_building": _in(V.V2_TRUST), "exclusivity": _in(V.V2_EXCLUSIVE),
    "total_slang": "len(sl)", "unique_slang": "len(list_distinct(sl))",
    "slang_proximity": f"coalesce(round(1.0::DOUBLE / (1 + list_min({_gaps('pos')})), 6), 0)",
    "slang_categories": _NCAT,
    "slang_density": "CASE WHEN len(words) = 0 THEN 0 ELSE round(len(sl) / len(words), 6) END",
    "caps_ratio": _density(f"[{V.UPPER}]"), "question_density": _density("[?]"), "exclamation_density": _density("!"),
    "number_density": _density(f"[{V.DIGIT_LIKE}]"), "special_char_density": _density(f"[{V.V2_SPECIAL_CHARS}]"),
}
LEX = {
    "slang_hits": "len(sh)", "emoji_hits": "len(eh)",
    "currency_count": f"len(regexp_extract_all(txt, '{V.LEX_CURRENCY_RX}'))",
    "contact_flag": _any(V.LEX_CONTACT), "available_flag": _any(V.LEX_AVAILABLE), "payment_flag": _any(V.LEX_PAYMENT),
}
_PAIRS = " + ".join(f"CAST(list_contains(eh, '{a}') AND list_contains(eh, '{b}') AS INTEGER)"
                    for b in V.V3_MONEY_EMOJIS for a in V.V3_DRUG_EMOJIS)
V3 = {
    "total_emojis": "len(eh)", "unique_emojis": "len(list_distinct(eh))", "suspicious_emoji_combos": _PAIRS,
    "urgent_time": flag_sql("low", V.V3_URGENT_TIME_RX), "late_hours": flag_sql("low", V.V3_LATE_RX),
    "discrete_location": flag_sql("low", V.V3_LOCATION_RX), "precise_quantity": flag_sql("low", V.V3_QUANTITY_RX),
    "price_negotiation": flag_sql("low", V.V3_PRICE_RX),
    "urgency_tactics": flag_sql("low", V.V3_URGENCY_RX.replace("'", "''")), "discretion_terms": flag_sql("low", V.V3_DISCRETION_RX),
    "quality_terms": flag_sql("low", V.V3_QUALITY_RX), "transaction_terms": flag_sql("low", V.V3_TRANSACTION_RX),
    "total_slang": "len(sh)", "unique_slang": "len(list_distinct(sh))",
    "slang_proximity": "len(list_filter(range(1, len(sh)), lambda i: instr(low, sh[i + 1]) - instr(low, sh[i]) < 20))",
    **BASIC,
}


def ext_sql(exprs, names, extra="", ctes=""):
    cols = ", ".join(f"{exprs[n]} AS {n}" for n in names)
    return f"WITH {EXT_SQL}{ctes} SELECT message_id, {cols}{extra} FROM ext"


def _register(name, exprs, names, fn, ctes=""):
    @query(name, ext_sql(exprs, names, ctes=ctes))
    def run(spark, sf_dir):
        return tidy(fn(messages(spark, sf_dir)).select("message_id", *names))


def _groups(*groups):
    return lambda df: FE.add(df, *groups)


SLANG_CTE = ", " + SLANG_SQL
_register("v1_emoji", V1, E.V1_NAMES[:3], _groups(E.v1_emoji_group))
_register("v1_context", V1, E.V1_NAMES[3:8], _groups(E.v1_context_group))
_register("v1_behavior", V1, E.V1_NAMES[8:12], _groups(E.v1_behavior_group))
_register("v1_slang", V1, E.V1_NAMES[12:15], _groups(E.v1_slang_group))
_register("v1_basic", V1, E.V1_NAMES[15:], _groups(E.basic_group))
_register("features_v1", V1, E.V1_NAMES, E.features_v1)
_register("v2_emoji", V2, E.V2_NAMES[:5], _groups(E.v2_emoji_group))
_register("v2_time_words", V2, ("urgent_time",), _groups(lambda p: {"urgent_time": E.v2_time_words(p.words)}))
_register("late_night_flag", V2, ("late_night",), _groups(lambda p: {"late_night": E.late_night(F.col("ts_text"))}))
_register("v2_location", V2, ("location_indicator", "discreet_location"), _groups(E.v2_location_group))
_register("v2_price_quantity", V2, ("price_pattern", "quantity_pattern"), _groups(E.v2_price_quantity_group))
_register("secure_platform_flag", V2, ("secure_platform",), _groups(lambda p: {"secure_platform": E.secure_platform(F.col("platform"))}))
_register("length_norm", V2, ("msg_length_norm",), _groups(lambda p: {"msg_length_norm": F.length(p.text) / 100.0}))
_register("v2_behavior", V2, E.V2_NAMES[13:19], _groups(E.v2_behavior_group))
_register("v2_slang", V2, E.V2_NAMES[19:24], _groups(E.v2_slang_group), SLANG_CTE)
_register("v2_style", V2, E.V2_NAMES[24:], _groups(E.v2_style_group))
_register("features_v2", V2, E.V2_NAMES, E.features_v2, SLANG_CTE)
_register("lexicon_hits", LEX, E.LEXICON_NAMES, E.features_lexicon)
_register("v3_emoji_combos", V3, E.V3_NAMES[:3], lambda df: E.add_v3(df, E.v3_emoji_group))
_register("v3_context", V3, E.V3_NAMES[3:8], lambda df: E.add_v3(df, E.v3_context_group))
_register("v3_behavior", V3, E.V3_NAMES[8:12], lambda df: E.add_v3(df, E.v3_behavior_group))
_register("v3_slang", V3, E.V3_NAMES[12:15], lambda df: E.add_v3(df, E.v3_slang_group))
_register("features_v3", V3, E.V3_NAMES, E.features_v3)


# --- positional functions ---
@query("word_bigrams", f"""WITH {MESSAGES_SQL}, {PARTS_SQL}, all_words AS (
   SELECT 'm' || message_id AS id, words FROM parts
   UNION ALL SELECT 'd' || doc_id, regexp_extract_all(lower(text), '[^{V.SPACE}]+') FROM documents),
 b AS (SELECT unnest({_BI}) AS bigram FROM all_words)
 SELECT bigram, count(*) AS n FROM b GROUP BY bigram""")
def word_bigrams(spark, sf_dir):
    texts = messages(spark, sf_dir).select(X.text_or_empty(F.col("message_text")).alias("t"))
    texts = texts.union(table(spark, sf_dir, "documents").select("text"))
    words = texts.select(X.tokens(F.lower("t")).alias("words"))
    return words.select(F.explode(X.bigrams(F.col("words"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


_register("emoji_pairs", V2, ("suspicious_sequence",), _groups(lambda p: {"suspicious_sequence": E.drug_money_pair(p.emojis)}))
_register("slang_proximity_flag", V1, ("slang_proximity",), _groups(lambda p: {"slang_proximity": E.near_flag(p.words, p.slang)}))
_register("slang_min_gap", V2, ("slang_proximity",), _groups(lambda p: {"slang_proximity": E.slang_closeness(p.words, p.slang)}))
_register("slang_char_proximity", V3, ("slang_proximity",),
          lambda df: E.add_v3(df, lambda p: {"slang_proximity": E.char_proximity(p.low, F.col("_slang_hits"))}))


@query("distinct_per_message", f"""WITH {EXT_SQL} SELECT message_id, len(list_distinct(emo)) AS unique_emojis,
 len(list_distinct(sl)) AS unique_slang,
 CASE WHEN len(words) = 0 THEN 0 ELSE round(len(list_distinct(words)) / len(words), 6) END AS type_token_ratio FROM ext""")
def distinct_per_message(spark, sf_dir):
    return tidy(E.distinct_counts(messages(spark, sf_dir)).select("message_id", "unique_emojis", "unique_slang", "type_token_ratio"))


_NUM = ", ".join(f"round(CAST({V1[n]} AS DOUBLE), 6) AS {n}" for n in E.V1_NAMES)


@query("feature_vector", f"WITH {EXT_SQL} SELECT message_id, {_NUM} FROM ext")
def feature_vector(spark, sf_dir):
    """Stack the 20 columns into an array and unpack it again."""
    stacked = E.to_vector(E.features_v1(messages(spark, sf_dir)), E.V1_NAMES).select("message_id", "vec")
    return tidy(E.from_vector(stacked, E.V1_NAMES))


@query("similarity_from_distance", """SELECT vec_id, label, round(1.0 / (1.0 + sqrt(list_sum(list_transform(embedding,
  lambda x: (x::DOUBLE - 0.1::DOUBLE) * (x::DOUBLE - 0.1::DOUBLE))))), 6) AS similarity FROM embeddings""")
def similarity_from_distance(spark, sf_dir):
    """Similarity of every stored vector to the constant vector of 0.1."""
    d2 = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + (x.cast("double") - 0.1) * (x.cast("double") - 0.1))
    return tidy(table(spark, sf_dir, "embeddings").select("vec_id", "label", X.similarity(F.sqrt(d2)).alias("similarity")))
