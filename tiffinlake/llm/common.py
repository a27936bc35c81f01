"""What several operators need: intermediate tables, row keys, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiffinlake.session import remove, scratch_dir

#: Bytes of text that a step in numpy works on at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_left: ContextVar[list[str] | None] = ContextVar("_left", default=None)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the tables that operators have left within it: its results have to be written by then."""
    token = _left.set([])
    try:
        yield
        for path in _left.get():
            remove(spark, path)
    finally:
        _left.reset(token)


def leave(path: str) -> str:
    """Note a table in the shared folder for `released`."""
    if _left.get() is not None:
        _left.get().append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, read from there on.

    `released` or `session.clear_scratch` deletes it.
    """
    path = leave(scratch_dir(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sampled(df: DataFrame, most: int, *key: str) -> DataFrame:
    """`most` rows of `df`, or all if there are no more: the first by a hash of `key`, the same each time.

    Rows are counted first, and those whose hash is too high to be among the
    first, some tenth apart, never reach the task that sorts the others.
    """
    place = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 40))
    share = (1.1 * most + 100) / max(1, df.count())
    near = df if share >= 1 else df.where(place < int(share * (1 << 40)))
    return near.orderBy(place, *key).limit(most)


def row_key(id_column: str, text_column: str) -> list[Column]:
    """128 bits that stand for a row's id and text, whatever the type of the id and also for nulls.

    Rows that repeat both share the key, and whatever is decided by it.
    """
    return [
        F.xxhash64(F.col(id_column), F.col(text_column)).alias("_k1"),
        F.xxhash64(F.lit(7), F.col(text_column), F.col(id_column)).alias("_k2"),
    ]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some `most` bytes of text each, or a single longer text."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for row, length in enumerate(lengths):
        if size and size + length > most:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += int(length)
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(array: pa.Array) -> list[bytes]:
    """The texts in UTF-8, null as empty."""
    return [value or b"" for value in array.cast(pa.binary()).to_pylist()]


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of `df` and more fields, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def boxed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """Each row of `docs` as a struct `_row`, safe from names that clash with `more`."""
    return docs.select(F.struct("*").alias("_row"), *more)
