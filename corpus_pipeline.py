"""A training corpus from `documents`: language, lines, near duplicates, test items, mix.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame;
`run` writes it as Parquet in the shared folder and rereads it as the next
stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiffinlake.llm import decontaminate, langid, linededup, mixing, ngramjoin
from tiffinlake.llm.common import released, table
from tiffinlake.session import remove, scratch_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; others, and empty ones, go."""
    return langid.reject_unknown(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go from all texts."""
    return linededup.drop_common_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngramjoin.keep_one(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark` go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with how many of their words it takes."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("test_items", test_items),
    ("mix", mix),
]

# Similarity of n-gram sets by MinHash and rank profiles have no SQL form;
# tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has left is deleted once the next has written its own, its other tables once it has itself."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
