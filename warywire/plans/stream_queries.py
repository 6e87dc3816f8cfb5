"""Registered queries: streams over the events table, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..session import fresh_path
from ..streaming import jobs as J
from .inputs import MESSAGES_SQL, derive_messages, table
from .registry import query, tidy
from .source_queries import _STORE_NORM, BAND_SQL, IDENT_SQL, PREDS_SQL


def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return derive_messages(J.message_stream(spark, sf_dir, schema, glob="events.parquet"))


@query("resumable_ingest", f"""WITH {MESSAGES_SQL} SELECT {IDENT_SQL} AS id, {_STORE_NORM} AS document, platform,
 coalesce(risk_level, 'unknown') AS risk_level FROM messages WHERE {_STORE_NORM} <> ''""")
def resumable_ingest(spark, sf_dir):
    """Ingest, then start again on the same checkpoint: the second run adds nothing."""
    dst, checkpoint = fresh_path(spark, "ingest"), fresh_path(spark, "ingest-checkpoint")
    for _ in range(2):
        J.start_ingest(stream(spark, sf_dir), dst, checkpoint).awaitTermination()
    return spark.read.parquet(dst).select("id", "document", "platform", "risk_level")


@query("stream_score", f"""WITH {PREDS_SQL} SELECT message_id, weighted_risk_score, round(probability, 6) AS score,
 {BAND_SQL} AS risk_level_predicted FROM preds""")
def stream_score(spark, sf_dir):
    dst, checkpoint = fresh_path(spark, "scored"), fresh_path(spark, "scored-checkpoint")
    scored = J.stream_score(stream(spark, sf_dir)).select("message_id", "weighted_risk_score", "score", "risk_level_predicted")
    J.run_to_parquet(scored, dst, checkpoint).awaitTermination()
    return tidy(spark.read.parquet(dst))


@query("stream_traffic_stats", f"""WITH {PREDS_SQL}, w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ws, count(*) AS messages,
   sum(CAST(probability >= 0.7 AS INTEGER)) AS flagged FROM preds GROUP BY 1)
 SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, CAST(ceil(messages / 10) AS BIGINT) AS requests, messages, flagged,
  round(flagged * 100.0::DOUBLE / messages, 6) AS flagged_pct, round(messages / 3600.0::DOUBLE, 6) AS messages_per_sec FROM w""")
def stream_traffic_stats(spark, sf_dir):
    dst, checkpoint = fresh_path(spark, "stats"), fresh_path(spark, "stats-checkpoint")
    J.run_updates(J.stream_stats(stream(spark, sf_dir), "1 hour", "1 hour"), dst, checkpoint).awaitTermination()
    out = J.latest(spark, dst)
    return tidy(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")))


@query("stream_recent_samples", f"""WITH {PREDS_SQL} SELECT message_id, left(message_text, 48) AS msg, round(probability, 6) AS score,
 {BAND_SQL} AS risk_level_predicted FROM preds ORDER BY ts DESC, message_id DESC LIMIT 6""")
def stream_recent_samples(spark, sf_dir):
    dst, checkpoint = fresh_path(spark, "recent"), fresh_path(spark, "recent-checkpoint")
    rows = J.stream_score(stream(spark, sf_dir)).select("message_id", "ts", X.preview(F.col("message_text"), 48).alias("msg"),
                                                        "score", "risk_level_predicted")
    J.stream_last_n(rows, dst, checkpoint).awaitTermination()
    return tidy(J.read_last_n(spark, dst).drop("ts"))
