"""Join of documents by the Jaccard similarity of their word n-grams, by MinHash bands.

Documents with equal sets are one class and are compared once. Each class goes
to one bucket per band of its MinHash signature; classes that share a bucket
are candidates, and the connected candidates are compared on their full sets.
Comparing counts the links of each class and leaves one edge to the smallest
class it reaches, never a row per pair, so that a group of thousands of near
copies gives thousands of rows. A large group is cut into cells by size of the
sets and by hash, and a task compares two cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffinlake.llm.common import boxed, row_key, slices, texts, written
from tiffinlake.llm.graph import components
from tiffinlake.llm.words import mixed, run_hashes, word_hashes

WORDS = 5
SIMILARITY = Fraction(4, 5)
#: A pair at the threshold shares a bucket with at least this probability.
RECALL = 0.9999
#: Values in a signature at most.
MOST_HASHES = 192
#: Classes in a cell, some.
CELL = 768
#: A member of so many sets or fewer is counted pair by pair.
FEW = 16
_A_WORD = r"[^\x20\x09-\x0D]"


def bands_and_rows(similarity: float = float(SIMILARITY), recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The longest bands, and as many as the recall takes, that need no more than `most` values.

    A pair of similarity s shares one of b bands of r rows with probability
    1 - (1 - s**r)**b.
    """
    fitting = []
    for rows in range(1, most + 1):
        if similarity**rows >= 1:
            return 1, 1
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(similarity**rows))))
        if bands * rows <= most:
            fitting.append((bands, rows))
    if not fitting:
        raise ValueError(f"no bands of {most} values reach a recall of {recall} at {similarity}")
    return fitting[-1]


def sets_of(values: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its n-grams, each once. A shorter text is one n-gram, none if it has no word."""
    words, begins = word_hashes(values)
    runs = run_hashes(words, size)
    out = []
    for start, end in zip(begins[:-1], begins[1:], strict=True):
        if end - start >= size:
            out.append(np.unique(runs[start : end - size + 1]))
        else:
            out.append(run_hashes(words[start:end], max(1, end - start)))
    return out


def class_of(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set that depend on its members only."""
    out = np.zeros((len(sets), 2), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for column, salt in enumerate((0x5BD1E995, 0xC2B2AE3D27D4EB4F)):
            out[full, column] = np.add.reduceat(mixed(flat ^ np.uint64(salt)), starts)
    return out.view(np.int64)


def _signatures(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    random = np.random.default_rng(5)
    factors = random.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
    terms = random.integers(0, 1 << 32, bands * rows, np.uint32)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(texts(part.column("text")), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                sets = [sets[i] for i in full]
                starts = np.cumsum([0, *map(len, sets[:-1])])
                short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
                keys = np.zeros((len(sets), bands), np.uint64)
                for k, (factor, term) in enumerate(zip(factors, terms, strict=True)):
                    least = np.minimum.reduceat(short * factor + term, starts)
                    band = keys[:, k // rows]
                    band *= np.uint64(0x9E3779B97F4A7C15)
                    band += least.astype(np.uint64) + np.uint64(k // rows)
                names = class_of(sets)
                keys = mixed(keys).view(np.int64)
                buckets = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel())
                )
                sizes = pa.array([len(s) for s in sets], pa.int64())
                rest = part.select(["doc_id", "_k1", "_k2"]).take(pa.array(full, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(names[:, 0]), pa.array(names[:, 1]), sizes, buckets],
                    ["doc_id", "_k1", "_k2", "c1", "c2", "n", "buckets"],
                )

    return step


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share.

    A member of few sets adds to each two of them; one of many is a column of
    a matrix, whose product with itself counts 2048 of them at a time.
    """
    count = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    lengths = np.diff(np.append(starts, len(flat)))
    shared = np.zeros(count * count, np.int64)
    pairs: list[np.ndarray] = []
    for length in np.unique(lengths[(lengths > 1) & (lengths <= FEW)]):
        groups = starts[lengths == length]
        members = owner[groups[:, None] + np.arange(length)]
        for i in range(length):
            for j in range(i + 1, length):
                pairs.append(members[:, i] * count + members[:, j])
        if sum(map(len, pairs)) > 1 << 20:
            shared += np.bincount(np.concatenate(pairs), minlength=count * count)
            pairs = []
    if pairs:
        shared += np.bincount(np.concatenate(pairs), minlength=count * count)
    shared = shared.reshape(count, count)
    many = np.flatnonzero(lengths > FEW)
    for at in range(0, len(many), 2048):
        columns = many[at : at + 2048]
        size = lengths[columns]
        places = np.arange(size.sum()) + np.repeat(starts[columns] - np.concatenate(([0], np.cumsum(size[:-1]))), size)
        block = np.zeros((count, len(columns)), np.float32)
        block[owner[places], np.repeat(np.arange(len(columns)), size)] = 1
        shared += np.triu(block @ block.T, 1).astype(np.int64)
    return shared + shared.T


def linked(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """Which two of some sets are as similar as that, as a matrix; a set is not linked to itself."""
    shared = _intersections(sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None, :] - shared
    out = shared * similarity.denominator >= similarity.numerator * union
    np.fill_diagonal(out, False)
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it reaches."""
    root = np.arange(len(links))
    while True:
        lower = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links)))
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def _compare(size: int, similarity: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by unit and class -> (c1, c2, links, root) of the classes with a link."""

    def settle(rows: dict[tuple[int, int], tuple]) -> pa.RecordBatch | None:
        names = list(rows)
        sets = [row[0] for row in rows.values()]
        side = np.array([row[1] for row in rows.values()])
        copies = np.array([row[2] for row in rows.values()])
        links = linked(sets, similarity)
        if (side >= 0).any():
            links &= side[:, None] != side[None, :]
        at = np.flatnonzero(links.any(axis=1))
        if not len(at):
            return None
        root = _roots(links)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([names[i][0] for i in at], pa.int64()),
                pa.array([names[i][1] for i in at], pa.int64()),
                pa.array((links @ copies)[at], pa.int64()),
                pa.array([names[root[i]][0] for i in at], pa.int64()),
            ],
            ["c1", "c2", "links", "root"],
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, {}
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(texts(part.column("text")), size)
                columns = [part.column(c).to_pylist() for c in ("unit", "c1", "c2", "side", "copies")]
                for own, (u, c1, c2, side, copies), name in zip(sets, zip(*columns, strict=True), class_of(sets), strict=True):
                    if u != unit:
                        if len(rows) > 1 and (found := settle(rows)):
                            yield found
                        unit, rows = u, {}
                    # The text was fetched by 64 bits of its key: another text is not this class.
                    if (c1, c2) == tuple(name):
                        rows[c1, c2] = (own, side, copies)
        if len(rows) > 1 and (found := settle(rows)):
            yield found

    return step


def _units(members: DataFrame, similarity: Fraction, cell: int) -> DataFrame:
    """Adds `unit` and `side` to (component, c1, n, ...): rows to be compared have a unit in common.

    A component of up to `cell` classes is a unit. A larger one is cut into
    levels of set size, a factor of 1 / similarity apart, and these by hash
    into cells; sets that can be similar are in the same or the next level, so
    units are pairs of cells of these, and only classes on different sides of
    a pair are compared, or all if it is a cell with itself.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(float(1 / similarity)))).cast("int")
    counted = members.groupBy("component").agg(F.count(F.lit(1)).alias("classes"))
    leveled = members.join(counted, "component").withColumn("level", level)
    whole = leveled.where(F.col("classes") <= cell).select(
        *members.columns, F.hex("component").alias("unit"), F.lit(-1).alias("side")
    )
    large = leveled.where(F.col("classes") > cell)
    cells = large.groupBy("component", "level").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells"))
    near = cells.select("component", F.explode(F.array(F.col("level") - 1, "level", F.col("level") + 1)).alias("level"), F.struct("level", "cells").alias("near"))
    near = near.groupBy("component", "level").agg(F.collect_list("near").alias("near"))
    own = large.join(cells, ["component", "level"]).join(near, ["component", "level"])
    mine = F.struct(F.col("level").alias("level"), F.pmod(F.xxhash64("c1"), F.col("cells")).cast("int").alias("cell"))
    others = F.flatten(
        F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["cells"] - 1), lambda i: F.struct(x["level"].alias("level"), i.alias("cell"))))
    )
    paired = own.select(*members.columns, mine.alias("mine"), F.explode(others).alias("other"))
    first, last = F.least("mine", "other"), F.greatest("mine", "other")
    unit = F.concat_ws(":", F.hex("component"), first["level"], first["cell"], last["level"], last["cell"])
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return whole.unionByName(paired.select(*members.columns, unit.alias("unit"), side.alias("side")))


def candidates(known: DataFrame) -> DataFrame:
    """(c1, component) of the classes that share a bucket with another; `component` is the same for all that buckets connect.

    Each class goes to the smallest one that it meets in any of its buckets,
    and on to where that one goes. In a large group most end up at a few
    classes, and only these, where they still meet in a bucket, are the edges
    that are left: a row for each, and not one for each class and bucket.
    """
    dealt = known.select("c1", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.min("c1").alias("centre")).where("classes > 1")
    near = written(dealt.join(shared, "bucket").groupBy("c1").agg(F.min("centre").alias("head")), "heads")
    # The head has a row of its own, being in the bucket.
    beyond = near.select(F.col("c1").alias("head"), F.col("head").alias("top"))
    tops = written(near.join(beyond, "head").select("c1", "top"), "tops")
    met = known.select("c1", "buckets").join(tops, "c1").select(F.explode("buckets").alias("bucket"), "top").distinct()
    first = met.groupBy("bucket").agg(F.min("top").alias("first"), F.count(F.lit(1)).alias("tops")).where("tops > 1")
    edges = met.join(first, "bucket").where("top <> first").select(F.col("top").alias("a"), F.col("first").alias("b")).distinct()
    joined = tops.join(components(edges).withColumnRenamed("node", "top"), "top", "left")
    return joined.select("c1", F.coalesce("component", "top").alias("component"))


def classes(
    docs: DataFrame, size: int = WORDS, similarity: Fraction = SIMILARITY, recall: float = RECALL, cell: int = CELL
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _k1, _k2, c1, c2) of the rows that have words, and what is known of each class (c1, c2).

    That is `copies`, its rows; `links`, the rows of other classes that are as
    similar as asked; `group`, the same for all that links connect; `first_doc`.
    """
    bands, rows = bands_and_rows(float(similarity), recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(
        docs.select("doc_id", *row_key("doc_id", "text"), "text").mapInArrow(
            _signatures(size, bands, rows), f"doc_id {kind}, _k1 long, _k2 long, c1 long, c2 long, n long, buckets array<long>"
        ),
        "signatures",
    )
    known = written(
        signed.groupBy("c1", "c2").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("n").alias("n"),
            F.min("doc_id").alias("first_doc"),
            F.min("_k1").alias("_k1"),
            F.any_value("buckets").alias("buckets"),
        ),
        "classes",
    )
    members = known.join(candidates(known), "c1")
    units = _units(members.select("component", "c1", "c2", "n", "copies", "_k1"), similarity, cell)
    compared = written(
        docs.select(row_key("doc_id", "text")[0], "text")
        .join(units.hint("shuffle_hash"), "_k1")
        .select("unit", "side", "c1", "c2", "copies", "text")
        .repartition("unit")
        .sortWithinPartitions("unit", "c1", "c2")
        .mapInArrow(_compare(size, similarity), "c1 long, c2 long, links long, root long"),
        "links",
    )
    groups = components(compared.select(F.col("c1").alias("a"), F.col("root").alias("b")).where("a <> b"))
    links = compared.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    joined = (
        known.select("c1", "c2", "copies", "first_doc")
        .join(links, ["c1", "c2"], "left")
        .join(groups.withColumnRenamed("node", "c1"), "c1", "left")
        .select("c1", "c2", "copies", "first_doc", F.coalesce("links", F.lit(0)).alias("links"), F.col("component").alias("group"))
    )
    return signed.select("doc_id", "_k1", "_k2", "c1", "c2"), written(joined, "linked-classes")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and n_links of each row of `docs`.

    n_links counts the other rows with a Jaccard similarity of at least
    `similarity` (0.8) of their sets of `size` (5) words; exact copies are such
    rows. class_id is the smallest doc_id that links lead to, the row's own if
    there is none. A text of fewer words is one n-gram. A null or empty text,
    or one without words, has no links, and its own doc_id as class. Rows that
    repeat are rows of their own. Sets are sets of 64-bit hashes.
    """
    rows, known = classes(docs, **options)
    grouped, alone = known.where("group IS NOT NULL"), known.where("group IS NULL")
    first = grouped.groupBy("group").agg(F.min("first_doc").alias("class_id"))
    named = grouped.join(first, "group").select("c1", "c2", "class_id", "links", "copies")
    named = named.unionByName(alone.select("c1", "c2", F.col("first_doc").alias("class_id"), "links", "copies"))
    named = named.select("c1", "c2", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    found = rows.join(named, ["c1", "c2"]).select("doc_id", "class_id", "n_links")
    bare = _without_words(docs).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(bare)


def _without_words(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(F.col("text").rlike(_A_WORD), F.lit(False)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each group of near duplicates, that of the smallest doc_id.

    Rows without words are in no group and stay. Of rows that are equal in id
    and text one stays.
    """
    rows, known = classes(docs, **options)
    best = F.min(F.struct("doc_id", "_k1", "_k2")).alias("best")
    group = F.when(F.col("group").isNotNull(), F.struct(F.col("group").alias("x"), F.lit(None).cast("long").alias("y"))).otherwise(
        F.struct(F.col("c1").alias("x"), F.col("c2").alias("y"))
    )
    of_class = rows.groupBy("c1", "c2").agg(best).join(known.select("c1", "c2", "group"), ["c1", "c2"])
    kept = of_class.groupBy(group.alias("any")).agg(F.min("best").alias("best")).select("best._k1", "best._k2")
    whole = boxed(docs, *row_key("doc_id", "text")).join(kept, ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    return whole.select("_row.*").unionByName(_without_words(docs))
