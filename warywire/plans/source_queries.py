"""Registered queries: sources, sinks, conforming, predicates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import conform as C
from ..operators import extractors as E
from ..operators import features as FE
from ..operators import joins as J
from ..session import fresh_path
from ..sources import files as S
from .feature_queries import FEATURES_SQL, PARTS_SQL, SLANG_IN, flag_sql
from .inputs import MESSAGES_SQL, messages, quote, sql_in, table
from .phrases import PHRASES
from .registry import query, tidy

MSG = ("platform", "message_type", "message_text", "risk_level")
MSG_COLS = ", ".join(MSG)
# an empty CSV field reads as null
CSV_COLS = "platform, message_type, nullif(message_text, '') AS message_text, risk_level"


@query("scan_messages_csv", f"WITH {MESSAGES_SQL} SELECT {CSV_COLS} FROM messages")
def scan_messages_csv(spark, sf_dir):
    path = fresh_path(spark, "messages-csv")
    S.write_csv(messages(spark, sf_dir).select(*MSG), path)
    return S.read_messages_csv(spark, path, multi_line=True)  # some texts hold line breaks


@query("sink_csv", f"WITH {MESSAGES_SQL} SELECT platform, risk_level, count(*) AS n, sum(length(message_text)) AS chars "
                   "FROM messages GROUP BY ALL")
def sink_csv(spark, sf_dir):
    path = fresh_path(spark, "sink-csv")
    S.write_csv(messages(spark, sf_dir).select(*MSG), path)
    back = S.read_messages_csv(spark, path, multi_line=True)
    return back.groupBy("platform", "risk_level").agg(
        F.count("*").alias("n"), F.sum(F.length("message_text")).alias("chars"))


_SLANG_VALUES = ", ".join(f"({quote(t)}, {quote(c)})" for t, c in V.slang_rows())
_EMOJI_VALUES = ", ".join(f"({quote(t)}, {quote(c)})" for t, c in V.emoji_rows())
SLANG_SQL = f"slang(term, category) AS (VALUES {_SLANG_VALUES})"
EMOJI_SQL = f"emoji(emoji, category) AS (VALUES {_EMOJI_VALUES})"


@query("scan_lexicons", f"""WITH {MESSAGES_SQL}, {PARTS_SQL}, {SLANG_SQL}, {EMOJI_SQL},
 lex AS (SELECT 'slang' AS kind, term, category FROM slang UNION ALL SELECT 'emoji', emoji, category FROM emoji),
 toks AS (SELECT unnest(words) AS term FROM parts UNION ALL
          SELECT unnest(regexp_extract_all(txt, '{X.alternation(V.emoji_terms())}')) FROM parts),
 seen AS (SELECT term, count(*) AS n FROM toks GROUP BY term)
 SELECT kind, lex.term, category, coalesce(n, 0) AS uses FROM lex LEFT JOIN seen ON lex.term = seen.term""")
def scan_lexicons(spark, sf_dir):
    """Every lexicon row with the number of its uses in the messages."""
    slang, emoji = S.read_lexicon(spark, kind="slang"), S.read_lexicon(spark, kind="emoji")
    lex = slang.select(F.lit("slang").alias("kind"), F.col("slang_term").alias("term"), F.col("drug_type").alias("category"))
    lex = lex.unionByName(emoji.select(F.lit("emoji").alias("kind"), F.col("emoji").alias("term"),
                                       F.col("drug_category").alias("category")))
    msgs = messages(spark, sf_dir)
    terms = [t for t, _ in (*V.slang_rows(), *V.emoji_rows())]  # only tokens of the lexicons are counted and shuffled
    words = J.exploded_tokens(msgs).select(F.col("token").alias("term")).filter(F.col("term").isin(terms))
    hits = msgs.select(F.explode(E.emoji_hits(X.text_or_empty(F.col("message_text")))).alias("term"))
    seen = words.unionByName(hits).groupBy("term").agg(F.count("*").alias("n"))
    return lex.join(seen, "term", "left").select("kind", "term", "category", F.coalesce("n", F.lit(0)).alias("uses"))


@query("scan_optional_source", f"WITH {MESSAGES_SQL} SELECT {CSV_COLS} FROM messages")
def scan_optional_source(spark, sf_dir):
    """One source is there, the other is missing and counts as empty."""
    path = fresh_path(spark, "optional-csv")
    S.write_csv(messages(spark, sf_dir).select(*MSG), path)
    there = S.read_optional(spark, path, S.MESSAGES, multi_line=True)
    missing = S.read_optional(spark, path + "-missing", S.MESSAGES)
    return there.unionByName(missing)


@query("parse_request_json", f"""WITH {MESSAGES_SQL} SELECT message_id, message_text AS query,
  CASE WHEN message_id % 2 = 0 THEN 3 ELSE 5 END AS "limit", platform, risk_level FROM messages""")
def parse_request_json(spark, sf_dir):
    """Each message as a JSON search request; null fields are left out of the body."""
    body = F.to_json(F.struct(
        F.col("message_text").alias("query"), F.when(F.col("message_id") % 2 == 0, 3).alias("limit"),
        "platform", "risk_level"))
    raw = messages(spark, sf_dir).select("message_id", body.alias("body"))
    return S.parse_requests(raw, "search")


@query("parse_graph_request", f"""WITH {MESSAGES_SQL} SELECT message_id, CAST(sender_id AS VARCHAR) AS user_id,
  CAST(sender_id AS VARCHAR) AS sender_id, CAST(receiver_id AS VARCHAR) AS receiver_id,
  CASE WHEN message_id % 3 = 0 THEN 1 ELSE 1 + message_id % 4 END AS weight FROM messages""")
def parse_graph_request(spark, sf_dir):
    edge = F.struct(
        F.col("sender_id").cast("string").alias("sender_id"), F.col("receiver_id").cast("string").alias("receiver_id"),
        F.when(F.col("message_id") % 3 != 0, 1 + F.col("message_id") % 4).alias("weight"))
    body = F.to_json(F.struct(F.col("sender_id").cast("string").alias("user_id"), F.array(edge).alias("interactions")))
    raw = messages(spark, sf_dir).select("message_id", body.alias("body"))
    return S.parse_requests(raw, "graph").select("message_id", "user_id", F.inline("interactions"))


_ERROR_SQL = """CASE WHEN message_id % 7 = 3 THEN 'invalid JSON' WHEN {missing} THEN '{field} is required' END AS error"""


@query("parse_predict_request", f"""WITH {MESSAGES_SQL} SELECT message_id, CASE WHEN message_id % 7 <> 3 AND message_id % 5 <> 1 THEN message_text END AS message,
  {_ERROR_SQL.format(missing="message_id % 5 = 1 OR message_text IS NULL", field="message")} FROM messages""")
def parse_predict_request(spark, sf_dir):
    """Each message as the body of a prediction request, some without the field and some broken."""
    body = F.to_json(F.struct(F.when(F.col("message_id") % 5 != 1, F.col("message_text")).alias("message")))
    broken = F.when(F.col("message_id") % 7 == 3, F.concat(F.lit("{\"message\": "), body)).otherwise(body)
    return S.check_requests(messages(spark, sf_dir).select("message_id", broken.alias("body")), "predict")


@query("parse_batch_request", f"""WITH {MESSAGES_SQL} SELECT message_id, CASE WHEN message_id % 7 <> 3 AND message_id % 5 <> 1 THEN len([message_text, platform]) ELSE 0 END AS texts,
  {_ERROR_SQL.format(missing="message_id % 5 = 1", field="messages")} FROM messages""")
def parse_batch_request(spark, sf_dir):
    """Two texts per body, some bodies without the field and some broken."""
    body = F.to_json(F.struct(F.when(F.col("message_id") % 5 != 1, F.array("message_text", "platform")).alias("messages")))
    broken = F.when(F.col("message_id") % 7 == 3, F.concat(body, F.lit("]"), F.lit("}"))).otherwise(body)
    broken = F.when(F.col("message_id") % 7 == 3, F.concat(F.lit("["), broken)).otherwise(broken)
    out = S.check_requests(messages(spark, sf_dir).select("message_id", broken.alias("body")), "batch")
    return out.select("message_id", F.coalesce(F.size("messages"), F.lit(0)).alias("texts"), "error")


@query("check_search_request", f"""WITH {MESSAGES_SQL} SELECT message_id, CASE WHEN message_id % 7 <> 3 AND message_id % 5 <> 1 THEN message_text END AS query,
  {_ERROR_SQL.format(missing="message_id % 5 = 1 OR message_text IS NULL", field="query")} FROM messages""")
def check_search_request(spark, sf_dir):
    """Each message as the body of a search, some without the field and some broken."""
    body = F.to_json(F.struct(F.when(F.col("message_id") % 5 != 1, F.col("message_text")).alias("query"), "platform"))
    broken = F.when(F.col("message_id") % 7 == 3, F.concat(F.lit("{\"query\": "), body)).otherwise(body)
    return S.check_requests(messages(spark, sf_dir).select("message_id", broken.alias("body")), "search").select("message_id", "query", "error")


@query("check_graph_request", f"""WITH {MESSAGES_SQL} SELECT message_id, CASE WHEN message_id % 7 <> 3 AND message_id % 5 <> 1 THEN CAST(sender_id AS VARCHAR) END AS user_id,
  {_ERROR_SQL.format(missing="message_id % 5 = 1", field="user_id")} FROM messages""")
def check_graph_request(spark, sf_dir):
    """Each message's sender as the body of a graph request, some without the field and some broken."""
    edge = F.struct(F.col("sender_id").cast("string").alias("sender_id"), F.col("receiver_id").cast("string").alias("receiver_id"))
    body = F.to_json(F.struct(F.when(F.col("message_id") % 5 != 1, F.col("sender_id").cast("string")).alias("user_id"), F.array(edge).alias("interactions")))
    broken = F.when(F.col("message_id") % 7 == 3, F.concat(F.lit("{\"user_id\": "), body)).otherwise(body)
    return S.check_requests(messages(spark, sf_dir).select("message_id", broken.alias("body")), "graph").select("message_id", "user_id", "error")


_LITERALS = [t for t, _ in PHRASES[:14]]


@query("messages_from_literals", f"""WITH {MESSAGES_SQL},
 lit(message_text) AS (VALUES {', '.join('(' + quote(t) + ')' for t in _LITERALS)})
 SELECT lit.message_text, 'telegram' AS platform, 'general' AS message_type, count(m.message_id) AS uses
 FROM lit LEFT JOIN messages m ON m.message_text = lit.message_text GROUP BY ALL""")
def messages_from_literals(spark, sf_dir):
    """Texts given in the program, with how often the messages repeat them exactly."""
    lit = S.literal_messages(spark, _LITERALS).drop("message_id")
    said = messages(spark, sf_dir).filter(F.col("message_text").isin(_LITERALS))
    uses = said.groupBy("message_text").agg(F.count("*").alias("n"))
    return lit.join(uses, "message_text", "left").select(
        "message_text", "platform", "message_type", F.coalesce("n", F.lit(0)).alias("uses"))


_STORE_NORM = (f"btrim(regexp_replace(replace(coalesce(message_text, ''), '�', ''), '[{V.SPACE}]+', ' ', 'g'))"
               .replace("btrim(", "trim("))
IDENT_SQL = f"sha256(concat_ws(chr(31), CAST(message_id AS VARCHAR), {_STORE_NORM}))"


@query("embedding_store_append", f"""WITH {MESSAGES_SQL}
 SELECT {IDENT_SQL} AS id, {_STORE_NORM} AS document, platform, coalesce(risk_level, 'unknown') AS risk_level FROM messages
 WHERE length({_STORE_NORM}) > 0""")
def embedding_store_append(spark, sf_dir):
    """Append the messages of each label state to a new store, then read it back."""
    path = fresh_path(spark, "store")
    records = C.with_identity(C.drop_blank(messages(spark, sf_dir)))
    records = records.select("id", F.col("message_text").alias("document"), "platform",
                             F.col("metadata")["risk_level"].alias("risk_level"))
    S.append_store(records.filter(F.col("risk_level") != "unknown"), path)
    S.append_store(records.filter(F.col("risk_level") == "unknown"), path)
    return S.read_store(spark, path)


# --- conforming, labels and unions ---
_SOURCES_SQL = f"""{MESSAGES_SQL},
 source_a AS (SELECT platform, message_text AS message, CASE WHEN risk_level IN ('high', 'medium') THEN 1
              WHEN risk_level = 'low' THEN 0 END AS suspicious FROM messages),
 source_b AS (SELECT text, toxic AS suspicious FROM documents LEFT JOIN labels USING (doc_id)),
 conformed AS (
  SELECT platform, 'general' AS message_type, message AS message_text,
         CASE WHEN suspicious = 1 THEN 'high' ELSE 'low' END AS risk_level FROM source_a
  UNION ALL
  SELECT 'Telegram', 'general', text, CASE WHEN suspicious = 1 THEN 'high' ELSE 'low' END FROM source_b)"""


def source_a(spark, sf_dir):
    label = F.when(F.col("risk_level").isin("high", "medium"), 1).when(F.col("risk_level") == "low", 0)
    return messages(spark, sf_dir).select("platform", F.col("message_text").alias("message"), label.alias("suspicious"))


def source_b(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("text", F.col("toxic").alias("suspicious"))


def conformed(spark, sf_dir):
    return C.union_sources(C.conform_source(source_a(spark, sf_dir)), C.conform_source(source_b(spark, sf_dir)))


@query("conform_sources", f"WITH {_SOURCES_SQL} SELECT * FROM conformed WHERE platform = 'Telegram'")
def conform_sources(spark, sf_dir):
    return C.filter_metadata(conformed(spark, sf_dir), platform="Telegram")


@query("union_sources", f"WITH {_SOURCES_SQL} SELECT * FROM conformed")
def union_sources(spark, sf_dir):
    return conformed(spark, sf_dir)


@query("append_negative_samples", f"""WITH {_SOURCES_SQL} SELECT * FROM conformed UNION ALL
 SELECT {list(V.NEGATIVE_PLATFORMS)}[i % 4 + 1], 'general', {list(V.NEGATIVE_TEXTS)}[i % 4 + 1], 'low' FROM range(1000) t(i)""")
def append_negative_samples(spark, sf_dir):
    return C.append_negatives(conformed(spark, sf_dir))


@query("label_from_flag", """SELECT doc_id, toxic, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS risk_level
 FROM documents LEFT JOIN labels USING (doc_id)""")
def label_from_flag(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "toxic", X.risk_from_flag(F.col("toxic")).alias("risk_level"))


@query("label_binary", f"""WITH {MESSAGES_SQL} SELECT message_id, risk_level,
 CASE WHEN risk_level IN ('high', 'medium') THEN 1 ELSE 0 END AS label FROM messages""")
def label_binary(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", "risk_level", X.label_binary(F.col("risk_level")).alias("label"))


@query("fill_missing_text", f"WITH {MESSAGES_SQL} SELECT message_id, coalesce(message_text, '') AS message_text FROM messages")
def fill_missing_text(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", X.text_or_empty(F.col("message_text")).alias("message_text"))


@query("scoring_defaults", """SELECT conv_id, turn, text AS message_text, 'Telegram' AS platform, 'general' AS message_type
 FROM conversations""")
def scoring_defaults(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message_text"))
    return C.with_scoring_defaults(texts)


@query("drop_blank", f"WITH {MESSAGES_SQL} SELECT message_id, {_STORE_NORM} AS message_text FROM messages WHERE {_STORE_NORM} <> ''")
def drop_blank(spark, sf_dir):
    return C.drop_blank(messages(spark, sf_dir)).select("message_id", "message_text")


@query("normalize_text", f"""WITH {MESSAGES_SQL}, all_texts AS (
  SELECT 'm' || message_id AS id, message_text FROM messages
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'p' || page_id, html FROM pages)
 SELECT id, {_STORE_NORM} AS normalized FROM all_texts""")
def normalize_text(spark, sf_dir):
    texts = messages(spark, sf_dir).select(F.concat(F.lit("m"), "message_id").alias("id"), "message_text")
    texts = texts.union(table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), "text"))
    texts = texts.union(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id"), "html"))
    return texts.select("id", X.normalize_text(F.col("message_text")).alias("normalized"))


@query("message_identity", f"""WITH {MESSAGES_SQL} SELECT message_id, {IDENT_SQL} AS id, coalesce(platform, 'unknown') AS platform,
 coalesce(risk_level, 'unknown') AS risk_level, {IDENT_SQL} AS meta_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp" FROM messages""")
def message_identity(spark, sf_dir):
    out = C.with_identity(messages(spark, sf_dir))
    meta = F.col("metadata")
    return out.select("message_id", "id", meta["platform"].alias("platform"), meta["risk_level"].alias("risk_level"),
                      meta["message_id"].alias("meta_id"), meta["timestamp"].alias("timestamp"))


@query("truncate_preview", """SELECT 'doc' AS kind, doc_id AS id, left(text, 50) AS preview FROM documents
 UNION ALL SELECT 'turn', conv_id * 1000 + turn, left(text, 48) FROM conversations""")
def truncate_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
                                                    X.preview(F.col("text")).alias("preview"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"),
                                                         X.preview(F.col("text"), 48))
    return docs.union(turns)


# --- predicates and bands ---
_UNSAFE = flag_sql("lower(t)", V.UNSAFE_RX)


@query("validate_messages", f"""WITH {MESSAGES_SQL}, all_texts AS (
  SELECT 'm' || message_id AS id, coalesce(message_text, '') AS t FROM messages
  UNION ALL SELECT 'd' || doc_id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages),
 checked AS (SELECT id, CASE WHEN NOT regexp_matches(t, '[^{V.SPACE}]') THEN '{V.BLANK_REASON}'
   WHEN length(t) > 10000 THEN '{V.LONG_REASON}' WHEN {_UNSAFE} THEN '{V.UNSAFE_REASON}' ELSE '' END AS reason FROM all_texts)
 SELECT id, reason = '' AS is_valid, reason FROM checked""")
def validate_messages(spark, sf_dir):
    texts = messages(spark, sf_dir).select(F.concat(F.lit("m"), "message_id").alias("id"), "message_text")
    texts = texts.union(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id"), "text"))
    texts = texts.union(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id"), "html"))
    return C.validate_messages(texts).select("id", "is_valid", "reason")


def scored(spark, sf_dir):
    """Messages with features, label, rule probability and the 0.5 decision."""
    out = FE.final_features(messages(spark, sf_dir))
    return out.withColumns({
        "true_label": X.label_binary(F.col("risk_level")),
        "probability": FE.rule_probability(),
    }).withColumn("predicted", X.apply_threshold(F.col("probability")))


# ends in `preds`: features plus true_label, probability, predicted
PREDS_SQL = f"""{FEATURES_SQL}, preds0 AS (SELECT *,
  CASE WHEN risk_level IN ('high', 'medium') THEN 1 ELSE 0 END AS true_label,
  weighted_risk_score / {float(V.MAX_SCORE)}::DOUBLE AS probability FROM features),
 preds AS MATERIALIZED (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted FROM preds0)"""

BAND_SQL = "CASE WHEN probability >= 0.7 THEN 'High' WHEN probability >= 0.4 THEN 'Medium' ELSE 'Low' END"


@query("risk_band", f"WITH {PREDS_SQL} SELECT message_id, round(probability, 6) AS probability, {BAND_SQL} AS risk_level FROM preds")
def risk_band(spark, sf_dir):
    return tidy(scored(spark, sf_dir).select("message_id", "probability", X.risk_band(F.col("probability")).alias("risk_level")))


@query("confidence_band", f"""WITH {PREDS_SQL}, c AS (SELECT message_id, greatest(0.0, least(1.0, probability * 1.5 - 0.1)) AS p FROM preds)
 SELECT message_id, round(p, 6) AS p, CASE WHEN p >= 0.8 OR p <= 0.2 THEN 'High' ELSE 'Medium' END AS confidence FROM c""")
def confidence_band(spark, sf_dir):
    """Confidence of a score that may leave [0, 1] and is clamped first."""
    p = F.col("probability") * 1.5 - 0.1
    return tidy(scored(spark, sf_dir).select("message_id", X.clamp(p).alias("p"), X.confidence_band(p).alias("confidence")))


_ACTION_CASES = " ".join(f"WHEN {BAND_SQL} = '{b}' THEN '{'; '.join(a)}'" for b, a in V.ACTIONS.items())


@query("recommended_actions", f"WITH {PREDS_SQL} SELECT message_id, {BAND_SQL} AS risk_level, CASE {_ACTION_CASES} END AS actions FROM preds")
def recommended_actions(spark, sf_dir):
    banded = scored(spark, sf_dir).select("message_id", X.risk_band(F.col("probability")).alias("risk_level"))
    return C.with_actions(banded).withColumn("actions", F.array_join("actions", "; "))


def _yn(c):
    return f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END"


@query("feature_detail_view", f"""WITH {FEATURES_SQL} SELECT message_id, CAST(to_json({{
 'Text Analysis': {{'Character Count': char_count, 'Word Count': word_count, 'Total Emojis': emoji_count,
   'Drug-Related Emojis': drug_emoji_count, 'Slang Words': slang_count}},
 'Pattern Detection': {{'Price Patterns': {_yn('has_price')}, 'Quantity Patterns': {_yn('has_quantity')},
   'Location Indicators': {_yn('has_location')}, 'Urgency Indicators': {_yn('has_urgency')}}},
 'Text Characteristics': {{'Has Punctuation': {_yn('has_punctuation')}, 'Has Capitalization': {_yn('has_capitalization')}}}
 }}) AS VARCHAR) AS details FROM features""")
def feature_detail_view(spark, sf_dir):
    out = C.feature_details(FE.final_features(messages(spark, sf_dir)))
    return out.select("message_id", F.to_json("details").alias("details"))


@query("apply_threshold", f"WITH {PREDS_SQL} SELECT message_id, CASE WHEN probability >= 0.4 THEN 1 ELSE 0 END AS predicted FROM preds")
def apply_threshold(spark, sf_dir):
    return scored(spark, sf_dir).select("message_id", X.apply_threshold(F.col("probability"), 0.4).alias("predicted"))


for _suffix, _kw, _where in (
    ("", {"platform": "Telegram", "risk_level": "high"}, "platform = 'Telegram' AND risk_level = 'high'"),
    ("_platform", {"platform": "Discord"}, "platform = 'Discord'"),
    ("_risk_level", {"risk_level": "medium"}, "risk_level = 'medium'"),
    ("_none", {}, "TRUE"),
):
    def _metadata_filter(spark, sf_dir, kw=_kw):
        return C.filter_metadata(messages(spark, sf_dir), **kw).select("message_id", *MSG)

    query("metadata_filter" + _suffix,
          f"WITH {MESSAGES_SQL} SELECT message_id, {MSG_COLS} FROM messages WHERE {_where}")(_metadata_filter)


@query("select_misclassified", f"""WITH {PREDS_SQL} SELECT message_id, round(probability, 6) AS probability,
 CASE WHEN predicted = 1 THEN 'fp' ELSE 'fn' END AS kind FROM preds WHERE predicted <> true_label""")
def select_misclassified(spark, sf_dir):
    preds = scored(spark, sf_dir).select("message_id", "probability", "true_label", "predicted")
    return tidy(C.misclassified_rows(preds).select("message_id", "probability", "kind"))


# --- joins and sets ---
@query("slang_semi_join", f"""WITH {MESSAGES_SQL}, {PARTS_SQL}, t AS (
  SELECT message_id, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM parts)
 SELECT message_id, pos, token FROM t WHERE token IN {SLANG_IN}""")
def slang_semi_join(spark, sf_dir):
    return J.slang_tokens(messages(spark, sf_dir), S.read_lexicon(spark))


@query("slang_category_join", f"""WITH {MESSAGES_SQL}, {PARTS_SQL}, {SLANG_SQL},
 t AS (SELECT message_id, unnest(words) AS token FROM parts)
 SELECT message_id, count(DISTINCT category) AS n_categories FROM t JOIN slang ON term = token GROUP BY message_id""")
def slang_category_join(spark, sf_dir):
    return J.slang_categories(messages(spark, sf_dir), S.read_lexicon(spark))


@query("emoji_category_join", f"""WITH {MESSAGES_SQL}, {PARTS_SQL}, {EMOJI_SQL},
 t AS (SELECT message_id, unnest(regexp_extract_all(txt, '{X.alternation(V.emoji_terms())}')) AS e FROM parts)
 SELECT message_id, category, count(*) AS n FROM t JOIN (SELECT DISTINCT * FROM emoji) l ON l.emoji = t.e GROUP BY ALL""")
def emoji_category_join(spark, sf_dir):
    return J.emoji_categories(messages(spark, sf_dir), S.read_lexicon(spark, kind="emoji"))


@query("prediction_label_join", f"""WITH {PREDS_SQL} SELECT message_id, message_text, platform, message_type, true_label, predicted,
 round(probability, 6) AS probability FROM preds""")
def prediction_label_join(spark, sf_dir):
    preds = scored(spark, sf_dir).select("message_id", "predicted", "probability")
    msgs = messages(spark, sf_dir).select("message_id", "message_text", "platform", "message_type",
                                          X.label_binary(F.col("risk_level")).alias("true_label"))
    return tidy(J.join_predictions(msgs, preds))


@query("token_set_intersection", f"""WITH {MESSAGES_SQL}, {PARTS_SQL} SELECT message_id,
 array_to_string(list_sort(list_distinct(list_filter(words, lambda w: w IN {SLANG_IN}))), '|') AS terms FROM parts""")
def token_set_intersection(spark, sf_dir):
    words = X.tokens(F.lower(X.text_or_empty(F.col("message_text"))))
    hits = messages(spark, sf_dir).select("message_id", X.matched_terms(words, V.slang_terms()).alias("terms"))
    return hits.select("message_id", F.array_join(F.array_sort("terms"), "|").alias("terms"))
