"""Registered queries: text vectorisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import vectorize as VZ
from .inputs import MESSAGES_SQL, messages, sql_in, table
from .registry import query, tidy


def terms_sql(source: str, ident: str, text: str, n: int, stop: bool = True) -> str:
    """CTE `docs` with id and terms (all 1..n-grams)."""
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '[{V.WORD}]{{2,}}')"
    if stop:
        words = f"list_filter({words}, lambda w: w NOT IN {sql_in(V.STOP_WORDS)})"
    grams = ["w"]
    if n >= 2:
        grams.append("list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])")
    if n >= 3:
        grams.append("list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])")
    return f"docs AS (SELECT id, list_concat({', '.join(grams)}) AS terms FROM (SELECT {ident} AS id, {words} AS w FROM {source}))"


def vocab_sql(size: int, min_df: int = 1) -> str:
    return f"""long AS (SELECT id, unnest(terms) AS term FROM docs),
 vocab AS (SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM long GROUP BY term HAVING count(DISTINCT id) >= {min_df}
   ORDER BY tf DESC, term LIMIT {size})"""


WEIGHTS_SQL = """n AS (SELECT count(*) AS docs FROM docs),
 raw AS (SELECT id, l.term, count(*) * (ln((1 + max(docs)) / (1 + max(df))) + 1) AS w FROM long l JOIN vocab v ON v.term = l.term, n GROUP BY id, l.term),
 weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""

DOCS = ("documents", "doc_id", "text")
MSGS = ("messages", "message_id", "message_text")


def doc_terms(spark, sf_dir, **kw):
    return VZ.with_terms(table(spark, sf_dir, "documents"), "text", **kw).select("doc_id", "terms")


def frequent_terms(spark, sf_dir, size):
    """``doc_terms`` less those that cannot be among the ``size`` most frequent."""
    return VZ.with_frequent_terms(table(spark, sf_dir, "documents"), "text", size=size).select("doc_id", "terms")


@query("tokenize_ngrams", f"WITH {terms_sql(*DOCS, 2)} SELECT id AS doc_id, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct FROM docs")
def tokenize_ngrams(spark, sf_dir):
    terms = doc_terms(spark, sf_dir)
    return terms.select("doc_id", F.size("terms").alias("n_terms"), F.size(F.array_distinct("terms")).alias("n_distinct"))


@query("tokenize_ngrams_messages", f"""WITH {MESSAGES_SQL}, {terms_sql(*MSGS, 3)}, long AS (SELECT unnest(terms) AS term FROM docs)
 SELECT term, count(*) AS n FROM long GROUP BY term""")
def tokenize_ngrams_messages(spark, sf_dir):
    return VZ.ngrams(messages(spark, sf_dir), n=(1, 3)).groupBy("term").agg(F.count("*").alias("n"))


@query("tfidf_vocabulary", f"WITH {terms_sql(*DOCS, 2)}, {vocab_sql(200)} SELECT * FROM vocab")
def tfidf_vocabulary(spark, sf_dir):
    return VZ.vocabulary(frequent_terms(spark, sf_dir, 200), 200)


@query("tfidf_vocabulary_trigrams", f"WITH {MESSAGES_SQL}, {terms_sql(*MSGS, 3)}, {vocab_sql(100)} SELECT * FROM vocab")
def tfidf_vocabulary_trigrams(spark, sf_dir):
    return VZ.vocabulary(VZ.with_terms(messages(spark, sf_dir), n=(1, 3)), 100)


@query("tfidf_vocabulary_large", f"WITH {terms_sql(*DOCS, 2, stop=False)}, {vocab_sql(50000, 2)} SELECT * FROM vocab")
def tfidf_vocabulary_large(spark, sf_dir):
    return VZ.vocabulary(doc_terms(spark, sf_dir, stop=()), 50000, 2)


@query("tfidf_weights", f"""WITH {terms_sql(*DOCS, 2)}, {vocab_sql(200)}, {WEIGHTS_SQL}
 SELECT id AS doc_id, term, round(weight, 6) AS weight FROM weights""")
def tfidf_weights(spark, sf_dir):
    terms = frequent_terms(spark, sf_dir, 200)
    return tidy(VZ.tfidf(terms, VZ.tfidf_model(terms, 200), "doc_id"))


@query("tfidf_weights_messages", f"""WITH {MESSAGES_SQL}, {terms_sql(*MSGS, 3)}, {vocab_sql(100)}, {WEIGHTS_SQL}
 SELECT id AS message_id, term, round(weight, 6) AS weight FROM weights""")
def tfidf_weights_messages(spark, sf_dir):
    terms = VZ.with_terms(messages(spark, sf_dir), n=(1, 3)).select("message_id", "terms")
    return tidy(VZ.tfidf(terms, VZ.tfidf_model(terms, 100)))


_HOT = {"platform": ["Discord", "Reddit", "Signal", "Telegram", "WhatsApp"], "message_type": ["availability", "general", "inquiry"]}
_HOT_COLS = [f"{c}_{v}" for c, vs in _HOT.items() for v in vs]


@query("one_hot", f"WITH {MESSAGES_SQL} SELECT message_id, "
       + ", ".join(f"CAST({c} = '{v}' AS INTEGER) AS {c}_{v}" for c, vs in _HOT.items() for v in vs) + " FROM messages")
def one_hot(spark, sf_dir):
    return VZ.one_hot(messages(spark, sf_dir), ["platform", "message_type"]).select("message_id", *_HOT_COLS)


@query("one_hot_unseen", f"WITH {MESSAGES_SQL} SELECT message_id, CAST(platform = 'Telegram' AS INTEGER) AS \"platform_Telegram\", "
       "CAST(platform = 'Discord' AS INTEGER) AS \"platform_Discord\" FROM messages")
def one_hot_unseen(spark, sf_dir):
    """Categories fitted elsewhere: platforms not among them become all zeros."""
    return VZ.one_hot(messages(spark, sf_dir), ["platform"], {"platform": ["Telegram", "Discord"]}).select(
        "message_id", "platform_Telegram", "platform_Discord")
