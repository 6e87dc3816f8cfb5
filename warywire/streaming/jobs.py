"""Structured Streaming jobs: ingest, scoring, traffic statistics, most recent samples.

All take an ordinary streaming DataFrame or folder, use the same expressions as the batch
operators, and keep their state in checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.conform import drop_blank, with_identity
from ..operators.features import final_features, rule_probability


def message_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 500,
                   glob: str | None = None) -> DataFrame:
    """A folder of parquet files as a stream; ``max_files`` bounds one batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def start_ingest(stream: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    """Normalise, drop blanks, add ids and metadata, append to the store.

    The position lives in the checkpoint and the file sink commits each batch once, so a
    restart neither repeats nor loses rows; ids are deterministic in any case.
    """
    records = with_identity(drop_blank(stream)).select(
        "id", F.col("message_text").alias("document"), "metadata", F.col("metadata")["risk_level"].alias("risk_level"),
        F.col("metadata")["platform"].alias("platform"))
    return (records.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint)
            .partitionBy("platform").trigger(availableNow=True).start())


def stream_score(stream: DataFrame) -> DataFrame:
    """All 34 features, the rule probability and its band. Stateless."""
    scored = final_features(stream)
    return scored.withColumn("score", rule_probability()).withColumn("risk_level_predicted", X.risk_band(F.col("score")))


def stream_stats(stream: DataFrame, window: str = "3 seconds", late: str = "10 seconds", batch: int = 10) -> DataFrame:
    """Per tumbling window: requests (of ``batch`` messages), messages, flagged, share and rate per second.

    The state is one row per open window; the watermark closes windows.
    """
    scored = stream_score(stream).withColumn("_ts", F.col("ts").cast("timestamp"))
    flagged = F.coalesce(F.sum((F.col("risk_level_predicted") == "High").cast("long")), F.lit(0))
    out = scored.withWatermark("_ts", late).groupBy(F.window("_ts", window).alias("w")).agg(
        F.count("*").alias("messages"), flagged.alias("flagged"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return out.select(
        F.col("w.start").alias("window_start"), F.ceil(F.col("messages") / batch).alias("requests"), "messages", "flagged",
        (F.col("flagged") * 100.0 / F.greatest("messages", F.lit(1))).alias("flagged_pct"),
        (F.col("messages") / seconds).alias("messages_per_sec"))


def run_to_parquet(df: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def run_updates(df: DataFrame, dst: str, checkpoint: str, key: str = "window_start") -> StreamingQuery:
    """Write every changed window of every batch, tagged by batch; ``latest`` reads the last state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    return (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(availableNow=True).start())


def latest(spark: SparkSession, dst: str, key: str = "window_start") -> DataFrame:
    """The newest row per key over all batches."""
    rows = spark.read.option("basePath", dst).parquet(f"{dst}/batch=*")
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")


def stream_last_n(stream: DataFrame, path: str, checkpoint: str, n: int = 6, order=("ts", "message_id")) -> StreamingQuery:
    """Keep the n most recent rows: each batch merges its own n with the last kept n.

    The result of batch b is the folder ``kept=b``; a replayed batch rewrites its own folder
    from that of the batch before it.
    """
    keys = [F.col(c).desc() for c in order]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        recent = batch.orderBy(*keys).limit(n)
        if batch_id > 0:
            before = spark.read.schema(batch.schema).parquet(f"{path}/kept={batch_id - 1}")
            recent = recent.unionByName(before).orderBy(*keys).limit(n)
        recent.write.mode("overwrite").parquet(f"{path}/kept={batch_id}")

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_last_n(spark: SparkSession, path: str) -> DataFrame:
    """The folder of the newest batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/kept=*")
    newest = rows.agg(F.max("kept")).first()[0]
    return rows.filter(F.col("kept") == newest).drop("kept")
