"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiffinlake.llm import brown, decontaminate, fim, graphann, langid, linededup, mixing, ngramjoin, pii, quality, substrings, vectorcodes, warc
from tiffinlake.llm.common import table


def op1_graph_ann(spark: SparkSession, folder: str) -> DataFrame:
    return graphann.nearest(table(spark, folder, "embeddings"))


def op2_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.digests(table(spark, folder, "documents"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(table(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, folder, "documents"))


def op11_fim(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(table(spark, folder, "documents"))


def op12_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectorcodes.compress(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_ann": op1_graph_ann,
    "op2_langid": op2_langid,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_ngram_join": op10_ngram_join,
    "op11_fim": op11_fim,
    "op12_brown_lm": op12_brown_lm,
    "op13_vector_codes": op13_vector_codes,
}
