"""Equi-joins between messages, lexicons, predictions and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import bounded_broadcast
from .extractors import emoji_hits


def exploded_tokens(msgs: DataFrame) -> DataFrame:
    words = X.tokens(F.lower(X.text_or_empty(F.col("message_text"))))
    return msgs.select("message_id", F.posexplode(words).alias("pos", "token"))


def slang_tokens(msgs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens that are lexicon terms: (message_id, pos, token)."""
    terms = lexicon.select(F.lower("slang_term").alias("token")).distinct()
    return exploded_tokens(msgs).join(bounded_broadcast(terms), "token", "left_semi").select(
        "message_id", "pos", "token")


def slang_categories(msgs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct categories among the matched tokens of each message that has any.

    A term listed under several categories counts for each of them. The pairs are made
    distinct before the shuffle, so a long message ships at most one row per category.
    """
    pairs = lexicon.select(F.lower("slang_term").alias("token"), F.col("drug_type").alias("category")).distinct()
    hits = exploded_tokens(msgs).select("message_id", "token").join(bounded_broadcast(pairs), "token")
    return hits.groupBy("message_id").agg(F.countDistinct("category").alias("n_categories"))


def emoji_categories(msgs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Emoji occurrences per message and category: (message_id, category, n)."""
    pairs = lexicon.select("emoji", F.col("drug_category").alias("category")).distinct()
    hits = msgs.select("message_id", F.explode(emoji_hits(X.text_or_empty(F.col("message_text")))).alias("emoji"))
    return hits.join(bounded_broadcast(pairs), "emoji").groupBy("message_id", "category").agg(
        F.count("*").alias("n"))


def join_predictions(msgs: DataFrame, preds: DataFrame) -> DataFrame:
    """Align texts, labels and predictions by message id (never by position)."""
    return msgs.join(preds, "message_id")
