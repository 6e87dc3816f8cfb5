"""The registered queries of the training-data operators, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, jaccard, linededup, mix, pieces, quality, resample, shard, simhash, topk, toxicity, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op11_word_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_banded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op13_common_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_virtual_slots": op2_virtual_slots,
    "op3_pieces": op3_pieces,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_url_models": op5_url_models,
    "op6_factorisation": op6_factorisation,
    "op7_simhash": op7_simhash,
    "op8_toxic_neighbours": op8_toxic_neighbours,
    "op9_top_products": op9_top_products,
    "op10_line_chunks": op10_line_chunks,
    "op11_word_automaton": op11_word_automaton,
    "op12_banded_tiles": op12_banded_tiles,
    "op13_common_ends": op13_common_ends,
}

SQL: dict[str, str] = {
    "op1_mix_sources": mix.SQL,
    "op9_top_products": topk.oracle(),
    "op10_line_chunks": linededup.SQL,
    "op11_word_automaton": resample.SQL,
}
