"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

# Nothing here depends on the size of the cluster or of the data: parallelism,
# memory and shuffle.partitions stay with whoever submits the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Without it every Column call walks the Python stack, which takes longer
    # than to plan and run a small query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "tiffinlake", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the library's settings and those of `conf`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`, or else one below the warehouse.

    Both are places that every executor reaches, and the same on a cluster and
    on one machine. A warehouse on the disk of one machine is none on a cluster:
    that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{warehouse} is on one machine: set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_scratch"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    return f"{scratch_root(spark)}/tiffinlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it; PySpark has no public call for these."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer needed; no error if there is none, but if it stays."""
    fs, place = file_system(spark, path)
    if not fs.delete(place, True) and fs.exists(place):
        raise OSError(f"could not delete {path}")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder another place on the same file system, where nothing is yet."""
    fs, place = file_system(spark, source)
    _, to = file_system(spark, target)
    if fs.exists(to):
        raise OSError(f"{target} is there already")
    fs.mkdirs(to.getParent())
    if not fs.rename(place, to):
        raise OSError(f"could not move {source} to {target}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder."""
    remove(spark, f"{scratch_root(spark)}/tiffinlake/{spark.sparkContext.applicationId}")
