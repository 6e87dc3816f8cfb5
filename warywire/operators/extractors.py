"""The notebook feature extractors: v1 (20 columns), v2 (29), lexicon (6) and v3 (20).

They share the prepared parts of ``features`` and are built-ins throughout. The slang
and emoji counts of the lexicon family take the evident word-boundary meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vocabulary as V
from .features import PARTS, Parts, add, parts, prepare

# --- v1 ---
def v1_emoji_group(p: Parts) -> dict[str, Column]:
    return {
        "total_emojis": F.size(p.emojis),
        "unique_emojis": F.size(F.array_distinct(p.emojis)),
        "suspicious_emoji_combos": F.size(X.tokens_in(p.emojis, V.V1_DRUG_EMOJIS)) > 1,
    }


def v1_context_group(p: Parts) -> dict[str, Column]:
    return {
        "urgent_time": X.any_substring("_low", V.V1_URGENT_TIME),
        "late_hours": X.any_substring("_low", V.V1_LATE_HOURS),
        "discrete_location": X.any_substring("_low", V.V1_LOCATION),
        "precise_quantity": p.low.rlike(V.V1_QUANTITY_RX),
        "price_negotiation": X.any_substring("_low", V.V1_PRICE) | p.low.rlike(V.V1_PRICE_RX),
    }


def v1_behavior_group(p: Parts) -> dict[str, Column]:
    return {
        "urgency_tactics": X.any_substring("_low", V.V1_URGENCY),
        "discretion_terms": X.any_substring("_low", V.V1_DISCRETION),
        "quality_terms": X.any_substring("_low", V.V1_QUALITY),
        "transaction_terms": X.any_substring("_low", V.V1_TRANSACTION),
    }


def near_flag(words: Column, terms, max_gap: int = 3) -> Column:
    """Any two consecutive lexicon tokens at most ``max_gap`` words apart."""
    return F.exists(X.steps(X.token_positions(words, terms)), lambda d: d <= max_gap)


def v1_slang_group(p: Parts) -> dict[str, Column]:
    unique = F.size(X.matched_terms(p.words, p.slang))
    return {"total_slang": unique, "unique_slang": unique, "slang_proximity": near_flag(p.words, p.slang)}


def basic_group(p: Parts) -> dict[str, Column]:
    letters = F.aggregate(p.words, F.lit(0), lambda acc, w: acc + F.length(w))
    return {
        "msg_length": F.length(p.text),
        "word_count": F.size(p.words),
        "avg_word_length": X.ratio(letters, F.size(p.words)),
        "question_marks": X.count_pattern(p.text, r"\?"),
        "exclamation_marks": X.count_pattern(p.text, "!"),
    }


# --- v2 ---
def drug_money_pair(emojis: Column) -> Column:
    """An adjacent pair of a drug and a money emoji, in either order."""
    n = F.greatest(F.size(emojis) - 1, F.lit(0))
    kind = F.transform(emojis, lambda e: F.when(e.isin(*V.V1_DRUG_EMOJIS), 1).when(e.isin(*V.V2_MONEY_EMOJIS), -1).otherwise(0))
    products = F.zip_with(F.slice(kind, 1, n), F.slice(kind, 2, n), lambda a, b: a * b)
    return F.array_contains(products, -1)


def v2_emoji_group(p: Parts) -> dict[str, Column]:
    return {
        "total_emojis": F.size(p.emojis),
        "unique_emojis": F.size(F.array_distinct(p.emojis)),
        "drug_money_combo": X.any_token(p.emojis, V.V1_DRUG_EMOJIS) & X.any_token(p.emojis, V.V2_MONEY_EMOJIS),
        "suspicious_sequence": drug_money_pair(p.emojis),
        "emoji_density": X.ratio(F.size(p.emojis), F.size(p.words)),
    }


def v2_time_words(words: Column) -> Column:
    return X.any_token(words, V.V2_TIME) | X.any_token(X.bigrams(words), V.V2_TIME_PAIRS)


def late_night(ts_text: Column) -> Column:
    """Hour >= 22 or <= 4 of a ``MM/DD/YYYY HH:MM`` text; unparsable or null is 0."""
    hour = F.hour(F.try_to_timestamp(ts_text, F.lit("M/d/yyyy H:m")))
    return F.coalesce((hour >= 22) | (hour <= 4), F.lit(False))


def secure_platform(platform: Column) -> Column:
    return F.coalesce(F.lower(platform).isin(*V.V2_SECURE_PLATFORMS), F.lit(False))


def v2_location_group(p: Parts) -> dict[str, Column]:
    return {
        "location_indicator": X.any_token(p.words, V.V2_LOCATION),
        "discreet_location": X.any_token(p.words, V.V2_DISCREET),
    }


def v2_price_quantity_group(p: Parts) -> dict[str, Column]:
    return {"price_pattern": p.low.rlike(V.V2_PRICE_RX), "quantity_pattern": p.low.rlike(V.V2_QUANTITY_RX)}


def v2_context_group(p: Parts) -> dict[str, Column]:
    return {
        "urgent_time": v2_time_words(p.words),
        "late_night": late_night(F.col("ts_text")),
        **v2_location_group(p),
        **v2_price_quantity_group(p),
        "secure_platform": secure_platform(F.col("platform")),
        "msg_length_norm": F.length(p.text) / 100.0,
    }


def v2_behavior_group(p: Parts) -> dict[str, Column]:
    return {
        "urgency_score": X.ratio(F.size(X.tokens_in(p.words, V.V2_URGENCY)), F.size(p.words)),
        "discretion_indicator": X.any_token(p.words, V.V2_DISCRETION),
        "quality_indicator": X.any_token(p.words, V.V2_QUALITY),
        "transaction_pattern": X.any_token(p.words, V.V2_TRANSACTION),
        "trust_building": X.any_token(p.words, V.V2_TRUST),
        "exclusivity": X.any_token(p.words, V.V2_EXCLUSIVE),
    }


def slang_closeness(words: Column, terms) -> Column:
    """1 / (1 + smallest gap of consecutive lexicon tokens), 0 with fewer than two."""
    gap = F.array_min(X.steps(X.token_positions(words, terms)))
    return F.coalesce(1.0 / (1.0 + gap), F.lit(0.0))


def category_count(hits: Column) -> Column:
    """Distinct categories of the matched terms; a term under several counts for each."""
    by_term: dict[str, list[str]] = {}
    for term, category in V.slang_rows():
        by_term.setdefault(term.lower(), []).append(category)
    lookup = F.create_map(*[
        item for term, cats in by_term.items() for item in (F.lit(term), F.array(*map(F.lit, cats)))])
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(hits), lambda t: lookup[t]))))


def v2_slang_group(p: Parts) -> dict[str, Column]:
    hits = X.tokens_in("_words", p.slang)
    return {
        "total_slang": p.hits,
        "unique_slang": F.size(F.array_distinct(hits)),
        "slang_proximity": slang_closeness(p.words, p.slang),
        "slang_categories": category_count(hits),
        "slang_density": X.ratio(p.hits, F.size(p.words)),
    }


def v2_style_group(p: Parts) -> dict[str, Column]:
    n = F.length(p.text)
    return {
        "caps_ratio": X.ratio(X.count_pattern(p.text, f"[{V.UPPER}]"), n),
        "question_density": X.ratio(X.count_pattern(p.text, r"\?"), n),
        "exclamation_density": X.ratio(X.count_pattern(p.text, "!"), n),
        "number_density": X.ratio(X.count_pattern(p.text, f"[{V.DIGIT_LIKE}]"), n),
        "special_char_density": X.ratio(X.count_pattern(p.text, f"[{V.V2_SPECIAL_CHARS}]"), n),
    }


# --- lexicon ---
def slang_hits(low: Column) -> Column:
    """Lexicon terms at word boundaries, leftmost first, the longest term winning."""
    edge = f"[{V.WORD}]"
    rx = f"(?<!{edge})(?:{X.grouped_alternation(V.slang_terms())})(?!{edge})"
    return F.regexp_extract_all(low, F.lit(rx), F.lit(0))


def emoji_hits(text: Column) -> Column:
    """Occurrences of lexicon emojis, longest entry first. The range test skips plain letters
    before any entry is tried."""
    lowest = min(ord(e[0]) for e in V.emoji_terms())
    rx = f"(?=[\\x{{{lowest:X}}}-\\x{{10FFFF}}])(?:{X.grouped_alternation(V.emoji_terms())})"
    return F.regexp_extract_all(text, F.lit(rx), F.lit(0))


def lexicon_group(p: Parts) -> dict[str, Column]:
    return {
        "slang_hits": F.size(slang_hits(p.low)),
        "emoji_hits": F.size(emoji_hits(p.text)),
        "currency_count": X.count_pattern(p.text, V.LEX_CURRENCY_RX),
        "contact_flag": X.any_substring("_low", V.LEX_CONTACT),
        "available_flag": X.any_substring("_low", V.LEX_AVAILABLE),
        "payment_flag": X.any_substring("_low", V.LEX_PAYMENT),
    }


# --- v3; the hit arrays are prepared once as _slang_hits and _emoji_hits ---
def v3_emoji_group(p: Parts) -> dict[str, Column]:
    """Lexicon emojis and the number of listed (drug, money or parcel) pairs both present."""
    hits = F.col("_emoji_hits")

    def present(emojis) -> Column:
        flags = [F.array_contains(hits, e).cast("int") for e in emojis]
        return flags[0] + flags[1] + flags[2]

    return {
        "total_emojis": F.size(hits),
        "unique_emojis": F.size(F.array_distinct(hits)),
        "suspicious_emoji_combos": present(V.V3_DRUG_EMOJIS) * present(V.V3_MONEY_EMOJIS),
    }


def v3_context_group(p: Parts) -> dict[str, Column]:
    return {
        "urgent_time": X.guarded("_low", V.V3_URGENT_TIME, V.V3_URGENT_TIME_RX),
        "late_hours": X.guarded("_low", V.V3_LATE, V.V3_LATE_RX),
        "discrete_location": X.guarded("_low", V.V3_LOCATION, V.V3_LOCATION_RX),
        "precise_quantity": X.guarded("_low", V.V3_QUANTITY, V.V3_QUANTITY_RX),
        "price_negotiation": X.guarded("_low", V.V3_PRICE, V.V3_PRICE_RX),
    }


def v3_behavior_group(p: Parts) -> dict[str, Column]:
    return {
        "urgency_tactics": X.guarded("_low", V.V3_URGENCY, V.V3_URGENCY_RX),
        "discretion_terms": X.guarded("_low", V.V3_DISCRETION, V.V3_DISCRETION_RX),
        "quality_terms": X.guarded("_low", V.V3_QUALITY, V.V3_QUALITY_RX),
        "transaction_terms": X.guarded("_low", V.V3_TRANSACTION, V.V3_TRANSACTION_RX),
    }


def char_proximity(low: Column, hits: Column, max_chars: int = 20) -> Column:
    """Consecutive hits whose first occurrences lie less than ``max_chars`` apart; a second
    hit that first occurs earlier counts as well."""
    places = F.transform(hits, lambda h: F.instr(low, h))
    return F.size(F.filter(X.steps(places), lambda d: d < max_chars))


def v3_slang_group(p: Parts) -> dict[str, Column]:
    hits = F.col("_slang_hits")
    return {
        "total_slang": F.size(hits),
        "unique_slang": F.size(F.array_distinct(hits)),
        "slang_proximity": char_proximity(p.low, hits),
    }


# --- DataFrame functions ---
V1_NAMES = (
    "total_emojis", "unique_emojis", "suspicious_emoji_combos",
    "urgent_time", "late_hours", "discrete_location", "precise_quantity", "price_negotiation",
    "urgency_tactics", "discretion_terms", "quality_terms", "transaction_terms",
    "total_slang", "unique_slang", "slang_proximity",
    "msg_length", "word_count", "avg_word_length", "question_marks", "exclamation_marks",
)
V3_NAMES = V1_NAMES
V2_NAMES = (
    "total_emojis", "unique_emojis", "drug_money_combo", "suspicious_sequence", "emoji_density",
    "urgent_time", "late_night", "location_indicator", "discreet_location", "price_pattern",
    "quantity_pattern", "secure_platform", "msg_length_norm",
    "urgency_score", "discretion_indicator", "quality_indicator", "transaction_pattern",
    "trust_building", "exclusivity",
    "total_slang", "unique_slang", "slang_proximity", "slang_categories", "slang_density",
    "caps_ratio", "question_density", "exclamation_density", "number_density", "special_char_density",
)
LEXICON_NAMES = ("slang_hits", "emoji_hits", "currency_count", "contact_flag", "available_flag", "payment_flag")


def features_v1(df: DataFrame) -> DataFrame:
    out = add(df, v1_emoji_group, v1_context_group, v1_behavior_group, v1_slang_group, basic_group)
    return out.select(*df.columns, *V1_NAMES)


def features_v2(df: DataFrame) -> DataFrame:
    """Needs message_text; platform and ts_text are taken as unknown where missing."""
    keep = df.columns
    for name in ("platform", "ts_text"):
        if name not in keep:
            df = df.withColumn(name, F.lit(None).cast("string"))
    out = add(df, v2_emoji_group, v2_context_group, v2_behavior_group, v2_slang_group, v2_style_group)
    return out.select(*keep, *V2_NAMES)


def features_lexicon(df: DataFrame) -> DataFrame:
    return add(df, lexicon_group).select(*df.columns, *LEXICON_NAMES)


def _prepare_v3(df: DataFrame) -> DataFrame:
    return prepare(df).withColumns({
        "_slang_hits": slang_hits(F.col("_low")), "_emoji_hits": emoji_hits(F.col("_text"))})


def add_v3(df: DataFrame, *groups) -> DataFrame:
    columns: dict[str, Column] = {}
    for group in groups:
        columns.update(group(parts()))
    return _prepare_v3(df).withColumns(columns).drop(*PARTS, "_slang_hits", "_emoji_hits")


def features_v3(df: DataFrame) -> DataFrame:
    out = add_v3(df, v3_emoji_group, v3_context_group, v3_behavior_group, v3_slang_group, basic_group)
    return out.select(*df.columns, *V3_NAMES)


def distinct_counts(df: DataFrame) -> DataFrame:
    """Unique emojis, unique slang terms and type-token ratio per message."""
    return add(df, lambda p: {
        "unique_emojis": F.size(F.array_distinct(p.emojis)),
        "unique_slang": F.size(X.matched_terms(p.words, p.slang)),
        "type_token_ratio": X.ratio(F.size(F.array_distinct(p.words)), F.size(p.words)),
    })


def to_vector(df: DataFrame, cols, out: str = "vec") -> DataFrame:
    """Stack numeric or boolean columns into one array<double>."""
    kinds = dict(df.dtypes)
    parts_ = [F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else F.col(c).cast("double") for c in cols]
    return df.withColumn(out, F.array(*parts_))


def from_vector(df: DataFrame, names, vec: str = "vec") -> DataFrame:
    """Unpack an array column into named columns."""
    return df.withColumns({n: F.element_at(vec, i + 1) for i, n in enumerate(names)}).drop(vec)


def numeric(df: DataFrame, cols) -> DataFrame:
    """Cast the named columns to double, booleans through 0 and 1."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: F.col(c).cast("int").cast("double") if isinstance(kinds[c], T.BooleanType) else F.col(c).cast("double")
        for c in cols})
