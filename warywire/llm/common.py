"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null. Java's ``\\S`` is that class."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A double in (0, 1) from the md5 of the parts, the same in every engine."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def bounded_rows(spark: SparkSession, rows: str, schema: T.StructType) -> DataFrame:
    """A small table from the JSON text of an array, without a Python worker."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), T.ArrayType(schema))).alias("r")).select("r.*")


def same(a: str, b: str) -> Column:
    """Null-safe equality of two columns."""
    return F.col(a).eqNullSafe(F.col(b))
