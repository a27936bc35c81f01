"""Connected components of a graph given by its edges."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffinlake.llm.common import leave
from tiffinlake.session import remove, scratch_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from (a, b) of type long; a component goes by its smallest node.

    Each round every node takes the smallest label around it and then the label
    of that label, until nothing changes: some log2 of the longest path. Labels
    go through tables in the shared folder, so that no lineage grows. Sums are
    partial before they are shuffled, and Spark splits the joins at nodes with
    many edges.
    """
    spark = edges.sparkSession
    place = leave(scratch_dir(spark, "components"))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = kept(both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    nearest = both.groupBy("node").agg(F.min("other").alias("other"))
    labels = kept(nearest.select("node", F.least("node", "other").alias("component")), "0")
    for count in itertools.count(1):
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("seen"))
        lower = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        # What the label itself was labelled; a label is a node, so that there is one.
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        fresh = kept(lower.join(above, "component").select("node", "old", F.least("component", "top").alias("component")), str(count))
        remove(spark, f"{place}/{count - 1}")
        labels = fresh.select("node", "component")
        if fresh.where("old <> component").isEmpty():
            remove(spark, f"{place}/edges")
            return labels
    raise AssertionError
