"""Small tables for the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *rows):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "vec_id long, embedding array<float>")


def odd(docs):
    """The same table with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("id", "rid", "row", "key", "size", "shard", "score", "cuts", "lines", "class", "fp", "_n", "t", "v"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
