"""The given tables, and the ``messages`` view that Spark derives from ``events``.

Every event becomes one message. The text is one of the example phrases, extended by the
event's own value and properties; the SQL twin below states the same view for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..session import LOCAL_PARTITIONS
from .phrases import PHRASES

PLATFORMS = {"click": "Telegram", "error": "Discord", "purchase": "WhatsApp", "signup": "Signal", "view": "Reddit"}
TYPES = ("general", "inquiry", "availability")
P = len(PHRASES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A local session may ask for so many partitions (``local_session``), since a table of
    one small file is one task; elsewhere the scan's own splits are used."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(LOCAL_PARTITIONS, None)
    return rows.repartition(int(parts)) if parts else rows


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_messages(table(spark, sf_dir, "events"))


def derive_messages(events: DataFrame) -> DataFrame:
    """One message per event; also works on a stream of events."""
    i = F.col("event_id")

    def pick(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))

    def extra(n, text):
        return F.when(i % n == 0, text).otherwise("")

    platform = F.lit("Reddit")
    for kind, name in reversed(PLATFORMS.items()):
        platform = F.when(F.col("event_type") == kind, name).otherwise(platform)
    text = F.concat(
        pick([t for t, _ in PHRASES], P),
        extra(11, F.concat(F.lit(" $"), F.floor("value").cast("string"))),
        extra(13, F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit("g"))),
        extra(17, F.lit(" 💊 💵")),
    )
    risk = pick([r for _, r in PHRASES], P)
    risk = F.when(i % 19 == 3, F.when(risk == "high", "low").otherwise("high")).otherwise(risk)
    return events.select(
        i.alias("message_id"),
        "ts",
        F.col("user_id").alias("sender_id"),
        ((F.col("user_id") * 7 + i) % 97).alias("receiver_id"),
        platform.alias("platform"),
        pick(TYPES, 3).alias("message_type"),
        F.when(i % 101 != 7, text).alias("message_text"),
        F.when(i % 59 != 5, F.when((risk == "high") & (i % 5 == 0), "medium").otherwise(risk)).alias("risk_level"),
        F.when(i % 29 == 0, "unknown").when(i % 31 != 0, F.date_format("ts", "MM/dd/yyyy HH:mm")).alias("ts_text"),
        F.col("value").alias("latency_ms"),
    )


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"



MESSAGES_SQL = f"""messages_raw AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         {sql_list([t for t, _ in PHRASES])}[event_id % {P} + 1] AS phrase,
         {sql_list([r for _, r in PHRASES])}[event_id % {P} + 1] AS risk0
  FROM events),
messages AS (
  SELECT event_id AS message_id, ts, user_id AS sender_id, (user_id * 7 + event_id) % 97 AS receiver_id,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PLATFORMS.items())} END AS platform,
    {sql_list(TYPES)}[event_id % 3 + 1] AS message_type,
    CASE WHEN event_id % 101 = 7 THEN NULL ELSE phrase
      || CASE WHEN event_id % 11 = 0 THEN ' $' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE '' END
      || CASE WHEN event_id % 13 = 0 THEN ' ' || json_extract_string(props, '$.k') || 'g' ELSE '' END
      || CASE WHEN event_id % 17 = 0 THEN ' 💊 💵' ELSE '' END END AS message_text,
    CASE WHEN event_id % 59 = 5 THEN NULL
         WHEN event_id % 19 = 3 AND risk0 = 'high' THEN 'low'
         WHEN event_id % 19 = 3 OR risk0 = 'high' THEN CASE WHEN event_id % 5 = 0 THEN 'medium' ELSE 'high' END
         ELSE 'low' END AS risk_level,
    CASE WHEN event_id % 29 = 0 THEN 'unknown' WHEN event_id % 31 = 0 THEN NULL
         ELSE strftime(ts, '%m/%d/%Y %H:%M') END AS ts_text,
    value AS latency_ms
  FROM messages_raw)"""


def _tokens_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{V.SPACE}]+')"


PARTS_SQL = f"""parts AS (
  SELECT *, {_tokens_sql('low')} AS words, regexp_extract_all(txt, '[{V.EMOJI}]') AS emo
  FROM (SELECT *, coalesce(message_text, '') AS txt, lower(coalesce(message_text, '')) AS low FROM messages))"""
