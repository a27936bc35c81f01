"""The food_orders table: null defaults, retention, layout, registration."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffinlake import schema
from tiffinlake.functions.order_columns import MS_PER_DAY, order_date
from tiffinlake.operators.codec import decode
from tiffinlake.session import exists, file_system, move, remove


def fill_defaults(rows: DataFrame, dimension_default: str | None = None) -> DataFrame:
    """Null metrics get their declared default, null dimensions optionally one.

    NaN is a value and stays, which is why this is not `na.fill`.
    """
    defaults = dict(schema.METRIC_DEFAULTS)
    if dimension_default is not None:
        defaults |= dict.fromkeys(schema.DIMENSIONS, dimension_default)
    types = dict(rows.dtypes)
    return rows.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value).cast(types[name]))
            for name, value in defaults.items()
            if name in types
        }
    )


def conform(messages: DataFrame, dimension_default: str | None = None) -> DataFrame:
    """Messages of enriched orders to rows of the table."""
    return fill_defaults(decode(messages, schema.FOOD_ORDERS), dimension_default)


def with_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn(schema.DATE_COLUMN, order_date(F.col(schema.TIME_COLUMN)))


def retain(rows: DataFrame, as_of_ms: int | Column, days: int = 1) -> DataFrame:
    """Rows of the last `days` days before `as_of_ms`, by event time.

    On a table with a date partition whole partitions are skipped as well; a
    partition of undated rows (time beyond year 9999) is still looked into.
    """
    as_of = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    cutoff = as_of - days * MS_PER_DAY
    kept = rows.where(F.col(schema.TIME_COLUMN) >= cutoff)
    if schema.DATE_COLUMN in rows.columns:
        date = F.col(schema.DATE_COLUMN)
        kept = kept.where(date.isNull() | (date >= order_date(cutoff)))
    return kept


#: Bits of each indexed column in the order of rows, of a hash with a seed that
#: tells the labels of orders apart early.
CLUSTER_BITS, CLUSTER_SEED = 8, 2


def cluster_key(columns: Sequence[str], bits: int = CLUSTER_BITS) -> Column:
    """A number by which rows with equal values in any of `columns` come near each other.

    It takes the first bit of a hash of each column, then the second of each,
    and so on. A stretch of rows in this order has few of the hashes of every
    column, where a sort by one column after the other would scatter the values
    of all but the first.
    """
    hashes = [F.xxhash64(F.col(c), F.lit(CLUSTER_SEED)) for c in columns]
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for value in hashes:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(value, bit).bitwiseAND(F.lit(1)))
    return key


def index_options(columns: Iterable[str] = schema.INDEX_COLUMNS) -> dict[str, str]:
    """What lets a reader skip row groups that hold no row with a value: the dictionary of a column, or else its Bloom filter.

    A reader looks into a dictionary by itself if the whole column of a row
    group is coded by it; Parquet writes the Bloom filter where it is not, with
    as many bits as the values that turn up take.
    """
    # Two sizes to choose from: each takes its memory for every file that is open.
    options = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number": "2"}
    for column in columns:
        options[f"parquet.enable.dictionary#{column}"] = "true"
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
    return options


def write_table(
    rows: DataFrame,
    path: str,
    batch: int,
    writer: str,
    rebalance: bool = False,
    max_records_per_file: int | None = None,
    row_group_bytes: int | None = None,
) -> None:
    """Add a batch of rows to the table at `path`, as Parquet files by UTC date, writer and batch.

    A batch is known by its writer and number. Writing it again, after a
    failure or by mistake, replaces it and doubles nothing; batches of other
    writers are left alone, whatever their numbers.

    Rows in time order need no shuffle: each task holds a few dates and writes
    a file for each. Rows in any order would leave a file per task and date;
    `rebalance` then lets AQE gather small dates in one task and split a date
    that holds most rows over many.

    Within a file rows are sorted by status and then clustered by the other
    indexed columns, each of which has its dictionary or a Bloom filter: a
    filter on any of them, or on some together, skips row groups.
    `row_group_bytes` sets how much a row group holds; small ones skip more.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", writer):
        raise ValueError(f"a writer's name is part of a path: {writer!r}")
    placed = with_date(rows).withColumns({schema.WRITER_COLUMN: F.lit(writer), schema.BATCH_COLUMN: F.lit(batch).cast("bigint")})
    _write(placed, path, rebalance, max_records_per_file, row_group_bytes)


def _write(
    placed: DataFrame, path: str, rebalance: bool, max_records_per_file: int | None = None, row_group_bytes: int | None = None
) -> None:
    if rebalance:
        placed = placed.hint("rebalance", schema.DATE_COLUMN)
    indexed = [c for c in schema.INDEX_COLUMNS if c in placed.columns]
    sort = [*map(F.col, schema.PARTITION_COLUMNS), *map(F.col, indexed[:1]), cluster_key(indexed[1:]), *map(F.col, indexed[1:])]
    writer = placed.sortWithinPartitions(*sort).write.mode("overwrite").partitionBy(*schema.PARTITION_COLUMNS)
    writer = writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").options(**index_options(indexed))
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path`, with the date of its partitions last."""
    rows = spark.read.schema(schema.FOOD_ORDERS_ON_DISK).parquet(path)
    return rows.drop(schema.WRITER_COLUMN, schema.BATCH_COLUMN)


def register_view(rows: DataFrame, name: str = "food_orders") -> None:
    """Make `rows` known to SQL; an earlier view of that name gives way."""
    rows.createOrReplaceTempView(name)


def create_table(spark: SparkSession, path: str, name: str = "food_orders") -> bool:
    """Enter the table at `path` in the catalog, with all its batches; False if it is there already.

    Called again it makes the dates and batches known that were written since,
    by listing the folders. A writer that says what it has written (`add_batch`)
    needs no listing. A name that stands for another place or other columns is
    an error.
    """
    created = not spark.catalog.tableExists(name)
    if created:
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({schema.FOOD_ORDERS_ON_DISK}) USING parquet "
            f"PARTITIONED BY ({', '.join(schema.PARTITION_COLUMNS)}) LOCATION '{place}'"
        )
    else:
        _same_table(spark, path, name)
    _add_partitions(spark, name, _batches(spark, path))
    return created


def add_batch(spark: SparkSession, path: str, name: str, batch: int, writer: str) -> None:
    """Make one batch of a registered table known, as a writer does once it has written it.

    Only the dates of the table are listed, and on each the folder of this batch.
    """
    _same_table(spark, path, name)
    _add_partitions(spark, name, _batches(spark, path, writer, batch))


def _same_table(spark: SparkSession, path: str, name: str) -> None:
    known = spark.table(name)
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").select("data_type").first()
    fs, wanted = file_system(spark, path)
    there = None if location is None else file_system(spark, location[0])[1]
    if there is None or fs.makeQualified(there).toUri() != fs.makeQualified(wanted).toUri():
        raise ValueError(f"{name} is a table at {location and location[0]}, not at {path}")
    if known.columns != schema.column_names(schema.FOOD_ORDERS_ON_DISK):
        raise ValueError(f"{name} has other columns: {known.columns}")


def _batches(spark: SparkSession, path: str, writer: str | None = None, batch: int | None = None) -> Iterator[list[tuple[str, str, str]]]:
    """(date, writer, batch) as the names of folders, date by date; those of one writer and batch, or all."""
    below = f"{schema.WRITER_COLUMN}={writer or '*'}/{schema.BATCH_COLUMN}={'*' if batch is None else batch}"
    for date in _folders(spark, path, f"{schema.DATE_COLUMN}=*"):
        found = (s.getPath() for s in _folders(spark, date.getPath().toString(), below))
        if rows := [(p.getParent().getParent().getName(), p.getParent().getName(), p.getName()) for p in found]:
            yield rows


#: Partitions that one statement adds.
PARTITIONS_AT_ONCE = 500


def _add_partitions(spark: SparkSession, name: str, batches: Iterable[list[tuple[str, str, str]]]) -> None:
    """Enter batches in the catalog, some in a statement; those that are there already stay."""

    def value(folder: str) -> str:
        text = folder.partition("=")[2]
        return "null" if text.startswith("__") else f"'{text}'"

    def add(specs: list[str]) -> None:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(specs)}")

    specs = []
    for rows in batches:
        for row in rows:
            specs.append(f"PARTITION ({', '.join(f'{c}={value(f)}' for c, f in zip(schema.PARTITION_COLUMNS, row, strict=True))})")
            if len(specs) == PARTITIONS_AT_ONCE:
                add(specs)
                specs = []
    if specs:
        add(specs)
    spark.catalog.refreshTable(name)


def _folders(spark: SparkSession, path: str, pattern: str) -> list:
    """What lies below `path`, of folders that fit; none if there is no such path."""
    fs, place = file_system(spark, f"{path}/{pattern}")
    return [s for s in fs.globStatus(place) or [] if s.isDirectory()]


def drop_expired(spark: SparkSession, path: str, as_of_ms: int, days: int = 1) -> list[str]:
    """Delete the dates that lie wholly before the retention period, each with one call.

    Only the folders of dates are listed, those that are still kept. The day
    that the cutoff falls into stays: `retain` hides its older rows. Rows
    without a usable time have no date; their batches go once they were written
    before the retention period.
    """
    cutoff = as_of_ms - days * MS_PER_DAY
    epoch = datetime.date(1970, 1, 1)
    dropped = set()
    for status in _folders(spark, path, f"{schema.DATE_COLUMN}=*"):
        value = status.getPath().getName().removeprefix(f"{schema.DATE_COLUMN}=")
        if value.startswith("__"):
            for batch in _folders(spark, status.getPath().toString(), "*/*"):
                if batch.getModificationTime() < cutoff:
                    remove(spark, batch.getPath().toString())
        elif (datetime.date.fromisoformat(value) - epoch).days < cutoff // MS_PER_DAY:
            remove(spark, status.getPath().toString())
            dropped.add(value)
    return sorted(dropped)


STAGE = "_compact"
#: Dates that are merged together, and batches of them, some.
DATES_AT_ONCE, BATCHES_AT_ONCE = 32, 2000


def compact(spark: SparkSession, path: str, least: int = 2) -> int:
    """Merge the batches of each date that has `least` or more of them; returns how many were merged.

    No row changes. On each date the last batch of every writer stays as it is,
    since a stream may still repeat it. A few dates are merged at a time: their
    folders are read, and no others. Merged files are first written aside, with
    the list of what they replace; a run that finds a finished list left by one
    that died completes it before all else. Readers and writers of the dates
    concerned should wait meanwhile.
    """
    for status in _folders(spark, path, f"{STAGE}/*"):
        _finish(spark, path, status.getPath().getName())
    merged, group, dates = 0, [], 0
    for batches in _batches(spark, path):
        number = lambda b: int(b[2].partition("=")[2])
        last = {}
        for b in batches:
            last[b[1]] = max(last.get(b[1], 0), number(b))
        old = [b for b in batches if number(b) < last[b[1]] or b[1].startswith(f"{schema.WRITER_COLUMN}=compact-")]
        if len(old) < least:
            continue
        group, dates = group + old, dates + 1
        if dates == DATES_AT_ONCE or len(group) >= BATCHES_AT_ONCE:
            merged += _merge(spark, path, group)
            group, dates = [], 0
    if group:
        merged += _merge(spark, path, group)
    remove(spark, f"{path}/{STAGE}")
    return merged


def _merge(spark: SparkSession, path: str, batches: list[tuple[str, str, str]]) -> int:
    name = f"compact-{uuid.uuid4().hex}"
    stage = f"{path}/{STAGE}/{name}"
    folders = ["/".join(b) for b in batches]
    rows = spark.read.schema(schema.FOOD_ORDERS_ON_DISK).option("basePath", path).parquet(*(f"{path}/{f}" for f in folders))
    rows = rows.withColumns({schema.WRITER_COLUMN: F.lit(name), schema.BATCH_COLUMN: F.lit(0).cast("bigint")})
    _write(rows, f"{stage}/rows", rebalance=True)
    spark.createDataFrame([(f,) for f in folders], "folder STRING").coalesce(1).write.mode("overwrite").text(f"{stage}/replaced")
    _finish(spark, path, name)
    return len(batches)


def _finish(spark: SparkSession, path: str, name: str) -> None:
    """Put merged files in the place of what they replace, if their list is complete.

    Each step can be repeated, and an error in one leaves all that the next run
    needs: what is merged is hidden beside the batches before any of these is
    deleted, and seen once all are.
    """
    stage, writer = f"{path}/{STAGE}/{name}", f"{schema.WRITER_COLUMN}={name}"
    if exists(spark, f"{stage}/replaced/_SUCCESS"):
        replaced = [row.value for row in spark.read.text(f"{stage}/replaced").collect()]
        for status in _folders(spark, f"{stage}/rows", f"{schema.DATE_COLUMN}=*/{writer}"):
            place = status.getPath()
            move(spark, place.toString(), f"{path}/{place.getParent().getName()}/.{writer}")
        for folder in replaced:
            remove(spark, f"{path}/{folder}")
        for date in sorted({folder.partition("/")[0] for folder in replaced}):
            hidden = f"{path}/{date}/.{writer}"
            if exists(spark, hidden):
                move(spark, hidden, f"{path}/{date}/{writer}")
    remove(spark, stage)
