"""Readers and writers: CSV tables, lexicons, typed JSON requests, literal rows, the message store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V

MESSAGES = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("message_type", T.StringType()),
    T.StructField("message_text", T.StringType()),
    T.StructField("risk_level", T.StringType()),
])
SLANG_LEXICON = T.StructType([
    T.StructField("slang_term", T.StringType()),
    T.StructField("drug_type", T.StringType()),
    T.StructField("definition", T.StringType()),
])
EMOJI_LEXICON = T.StructType([
    T.StructField("emoji", T.StringType()),
    T.StructField("meaning", T.StringType()),
    T.StructField("drug_category", T.StringType()),
])
REQUESTS = {
    "predict": "message string",
    "batch": "messages array<string>",
    "search": "query string, limit int, platform string, risk_level string",
    "graph": "user_id string, interactions array<struct<sender_id: string, receiver_id: string, weight: int>>",
}

# quotes are doubled inside quoted fields; blanks at the ends of a field are data
_CSV = {
    "header": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_messages_csv(spark: SparkSession, path: str, schema: T.StructType = MESSAGES,
                      multi_line: bool = False) -> DataFrame:
    """Header CSV with an explicit schema, so there is no inference pass over the data.

    Large files split. Files whose quoted text holds line breaks need ``multi_line``, which makes a file
    the unit of work. An empty field reads as null.
    """
    return spark.read.options(**_CSV, multiLine=multi_line).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**_CSV).csv(path)


def read_lexicon(spark: SparkSession, path: str | None = None, kind: str = "slang") -> DataFrame:
    """A lexicon table from a CSV file, or the built-in one when no path is given."""
    schema = {"slang": SLANG_LEXICON, "emoji": EMOJI_LEXICON}[kind]
    if path is not None:
        return read_messages_csv(spark, path, schema)
    if kind == "slang":
        rows = [(term, category, None) for term, category in V.slang_rows()]
    else:
        rows = [(emoji, None, category) for emoji, category in V.emoji_rows()]
    return spark.createDataFrame(rows, schema)


def lexicon_terms(lexicon: DataFrame, max_rows: int = 10_000) -> tuple[str, ...]:
    """The distinct lower-cased terms of a lexicon, for use as a literal set in expressions.

    A lexicon beyond ``max_rows`` is refused here; join it instead (see ``operators.joins``).
    """
    term = lexicon.columns[0]
    rows = lexicon.select(F.lower(term).alias("t")).distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"lexicon has more than {max_rows} terms: use the join operators")
    return tuple(sorted(r.t for r in rows if r.t))


def read_optional(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Like ``read_messages_csv``, but a missing path gives an empty table."""
    try:
        return read_messages_csv(spark, path, schema, multi_line)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_requests(raw: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Parse JSON bodies of one request kind into typed columns, with defaults filled in."""
    parsed = raw.withColumn("_r", F.from_json(body, REQUESTS[kind]))
    if kind == "search":
        fields = {
            "query": F.col("_r.query"), "limit": F.coalesce(F.col("_r.limit"), F.lit(5)),
            "platform": F.col("_r.platform"), "risk_level": F.col("_r.risk_level"),
        }
    elif kind == "graph":
        edges = F.transform("_r.interactions", lambda e: F.struct(
            e.sender_id.alias("sender_id"), e.receiver_id.alias("receiver_id"),
            F.coalesce(e.weight, F.lit(1)).alias("weight")))
        fields = {"user_id": F.col("_r.user_id"), "interactions": edges}
    elif kind == "batch":
        fields = {"messages": F.col("_r.messages")}
    else:
        fields = {"message": F.col("_r.message")}
    return parsed.withColumns(fields).drop("_r", body)


REQUIRED = {"predict": ("message",), "batch": ("messages",), "search": ("query",), "graph": ("user_id",)}


def check_requests(raw: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Like ``parse_requests``, with ``error``: what makes the body unusable, else null.

    A body that is no JSON object of the right types is 'invalid JSON'; a required field that is absent or
    null is named ('message is required').
    """
    schema = T.StructType([*T._parse_datatype_string(REQUESTS[kind]).fields, T.StructField("_broken", T.StringType())])
    seen = raw.withColumn("_c", F.from_json(body, schema, {"columnNameOfCorruptRecord": "_broken"}))
    error = F.lit(None).cast("string")
    for name in reversed(REQUIRED[kind]):
        error = F.when(F.col(f"_c.{name}").isNull(), f"{name} is required").otherwise(error)
    broken = F.col("_c").isNull() | F.col("_c._broken").isNotNull()
    return parse_requests(seen.withColumn("error", F.when(broken, "invalid JSON").otherwise(error)).drop("_c"), kind, body)


def literal_messages(spark: SparkSession, texts: Sequence[str], platform: str = "telegram",
                     message_type: str = "general") -> DataFrame:
    """A small table from texts given in the program."""
    rows = [(i, t) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, "message_id long, message_text string")
    return out.withColumns({"platform": F.lit(platform), "message_type": F.lit(message_type)})


def append_store(df: DataFrame, path: str) -> None:
    """Append records to the message store, one folder per platform so that a platform
    filter reads only its folder."""
    df.write.mode("append").partitionBy("platform").parquet(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
