"""Substring dedup: words covered by a window of 20 words that starts earlier elsewhere go.

Two equal runs of 20 words begin anywhere. The set {0, 1, 3, 9} modulo 13 is a
difference cover: whatever their two beginnings, within the next 13 words there
is a place that lies in the set, modulo 13, in both documents. So it is enough
to hash the 8 words at these places, 4 of 13, and equal runs share such an
anchor. Only around anchors that occur twice is every window of 20 words hashed
and its first occurrence found; the others are repeats.

Both rounds shuffle hashes in packed arrays, one row for each bucket of hashes
and some two million entries. Entries that are equal within these are settled
before the shuffle and one of them is sent, so that a passage of a third of all
documents puts no more into its bucket than any other does. There are as many
buckets as the counted bytes of text ask for, so that a bucket, which a task
holds in memory, is as large at any size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tiffinlake.llm.common import boxed, row_key, slices, texts, with_fields, written
from tiffinlake.llm.words import run_hashes, word_hashes

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Entries that a task packs at a time.
PACK = 2_000_000
#: Bytes of text for each bucket: some 3 million anchors, and 11 million windows if all of them are repeats.
BUCKET_BYTES = 64 << 20

_PACKED = "bucket int, origin long, direct boolean, docs binary, counts binary, hashes binary, seen binary, places binary"
_NAMES = [part.split()[0] for part in _PACKED.split(", ")]
_RETURNED = "origin long, docs binary, counts binary, places binary"
_BACK = [part.split()[0] for part in _RETURNED.split(", ")]
_FLAGS = "_k1 long, _k2 long, places binary"
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The bytes of each part of an array, parts beginning at `begins` (and ending at its last)."""
    values = np.ascontiguousarray(values)
    offsets = (begins * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


def _packed(
    docs: np.ndarray, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray, seen: np.ndarray, buckets: int, bits: int
) -> pa.RecordBatch:
    """Entries, in order of doc and place, as a row for each bucket.

    docs: (documents, columns) of what is known of each document, sent with
    the entries that name it; the key of the first one names the pack. seen:
    hashes without a place. bits: how many of a hash are sent, as the bucket
    stands for others.
    """
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    seen_bucket = (seen % np.uint64(buckets)).astype(np.int32)
    seen = seen[np.argsort(seen_bucket, kind="stable")]
    bucket, doc = bucket[order], doc[order]
    all_buckets = np.unique(np.concatenate((bucket, seen_bucket)))
    begins = np.append(np.searchsorted(bucket, all_buckets), len(bucket))
    seen_begins = np.append(np.searchsorted(np.sort(seen_bucket), all_buckets), len(seen))
    # A document's entries in a bucket stand together.
    runs = _runs_of(bucket.astype(np.int64) * (len(docs) + 1) + doc)
    run_begins = np.searchsorted(runs[:-1], begins)
    rows = len(all_buckets)
    sent = lambda values: (values >> np.uint64(64 - bits)).astype(f"u{bits // 8}")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(all_buckets, pa.int32()),
            pa.array([int(docs[0, 0])] * rows, pa.int64()),
            pa.array([False] * rows),
            _binary(docs[doc[runs[:-1]]].view(f"V{docs.shape[1] * 8}").ravel(), run_begins),
            _binary(np.diff(runs).astype(np.int32), run_begins),
            _binary(sent(hashes[order]), begins),
            _binary(sent(seen), seen_begins),
            _binary(place[order], begins),
        ],
        _NAMES,
    )


def _places(origin: int, docs: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    """Places by document, as one row that goes back to where they come from."""
    begins = _runs_of(doc)
    whole = lambda values: pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
    return [pa.array([origin], pa.int64()), whole(docs[doc[begins[:-1]]]), whole(np.diff(begins).astype(np.int32)), whole(place)]


def _direct(docs: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places that need no bucket to decide on them, in order of doc."""
    origin, keys, counts, places = _places(int(docs[0, 0]), docs, doc, place)
    empty = pa.nulls(1, pa.binary())
    bucket = pa.array([int(docs[0, 0]) % buckets], pa.int32())
    return pa.RecordBatch.from_arrays([bucket, origin, pa.array([True]), keys, counts, empty, empty, places], _NAMES)


def _unpacked(group: pa.Table, columns: int, kind: type) -> tuple[np.ndarray, ...]:
    """docs, doc, place, origin, hashes, seen of the packed rows of a bucket."""
    join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    docs = join("docs", np.int64).reshape(-1, columns)
    place = join("places", np.int32)
    sizes = [len(p) // 4 for p in group.column("places").to_pylist()]
    origin = np.repeat(group.column("origin").to_numpy(), sizes)
    return docs, np.repeat(np.arange(len(docs)), join("counts", np.int32)), place, origin, join("hashes", kind), join("seen", kind)


def _returned(group: pa.Table, docs: np.ndarray, doc: np.ndarray, place: np.ndarray, origin: np.ndarray, hit: np.ndarray) -> pa.Table:
    """What passes through a bucket, and the entries found, in a row for each pack they came in."""
    hit = np.sort(hit)
    rows = [batch for batch in group.filter(group.column("direct")).select(_BACK).to_batches() if batch.num_rows]
    begins = _runs_of(origin[hit])
    for start, end in zip(begins[:-1], begins[1:], strict=True):
        own = hit[start:end]
        rows.append(pa.RecordBatch.from_arrays(_places(int(origin[own[0]]), docs, doc[own], place[own]), _BACK))
    return pa.Table.from_batches(rows, schema=pa.schema(zip(_BACK, [pa.int64(), *[pa.binary()] * 3], strict=True)))


def _by_document(group: pa.Table) -> pa.Table:
    """Rows that came back to a pack -> a row for each of its documents."""
    counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int32)
    docs = np.frombuffer(b"".join(group.column("docs").to_pylist()), np.int64).reshape(len(counts), -1)
    place = np.frombuffer(b"".join(group.column("places").to_pylist()), np.int32)
    keys, doc = np.unique(docs[:, [0, -1]], axis=0, return_inverse=True)
    doc = np.repeat(doc.ravel(), counts)
    order = np.argsort(doc, kind="stable")
    places = _binary(place[order], np.searchsorted(doc[order], np.arange(len(keys) + 1)))
    return pa.table([pa.array(keys[:, 0]), pa.array(keys[:, 1]), places], ["_k1", "_k2", "places"])


class _Pack:
    """Collects entries of many documents; `settle` turns some millions of them into rows."""

    def __init__(self, settle: Callable[..., Iterator[pa.RecordBatch]]):
        self.settle, self.parts, self.count, self.size = settle, [], 0, 0

    def add(self, docs: np.ndarray, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((docs, doc + self.count, place.astype(np.int32), hashes))
        self.count += len(docs)
        self.size += len(doc)
        if self.size >= PACK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from self.settle(*map(np.concatenate, zip(*self.parts, strict=True)))
        self.parts, self.count, self.size = [], 0, 0


def _positions(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its document, its place in it, and how many words the document has."""
    lengths = np.diff(begins)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return doc, np.arange(begins[-1]) - np.repeat(begins[:-1], lengths), np.repeat(lengths, lengths)


def _anchors(window: int, buckets: int) -> Step:
    """Documents -> packed anchors, and flags of those that are repeated in a task."""
    size = window - PERIOD + 1

    def settle(docs, doc, place, hashes):
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        later, repeated = np.concatenate(([False], same)), np.concatenate((same, [False]))
        repeated |= later
        single = np.sort(order[~repeated])
        yield _packed(docs, doc[single], place[single], hashes[single], hashes[order[repeated & ~later]], buckets, 32)
        if repeated.any():
            local = np.sort(order[repeated])
            yield _direct(docs, doc[local], place[local], buckets)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack(settle)
        for batch in batches:
            for part in slices(batch, "text"):
                words, begins = word_hashes(texts(part.column("text")))
                doc, place, length = _positions(begins)
                at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + size <= length) & (length >= window))
                runs = run_hashes(words, size)
                yield from pack.add(part.column("_k1").to_numpy().reshape(-1, 1), doc[at], place[at], runs[at])
        yield from pack.flush()

    return step


def _repeated_anchors(group: pa.Table) -> pa.Table:
    """The entries of a bucket whose hash occurs twice."""
    docs, doc, place, origin, hashes, seen = _unpacked(group.filter(pc.invert(group.column("direct"))), 1, np.uint32)
    values, counts = np.unique(np.concatenate((hashes, seen, seen)), return_counts=True)
    repeated = values[counts > 1]
    at = np.minimum(np.searchsorted(repeated, hashes), max(0, len(repeated) - 1))
    hit = np.flatnonzero(repeated[at] == hashes) if len(repeated) else np.empty(0, np.int64)
    return _returned(group, docs, doc, place, origin, hit)


def _later(docs: np.ndarray, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first entry of each hash, by doc_id and place, and of those after it."""
    _, rank = np.unique(docs[:, 1], return_inverse=True)
    when = (rank[doc].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
    order = np.lexsort((when, hashes))
    begins = _runs_of(hashes[order])
    first = order[begins[:-1]]
    after = when[order] > np.repeat(when[first], np.diff(begins))
    return first, order[after]


def _windows(window: int, buckets: int) -> Step:
    """Documents with flagged anchors -> packed windows around these, and flags of repeats within a task."""

    def settle(docs, doc, place, hashes):
        first, after = _later(docs, doc, place, hashes)
        first = np.sort(first)
        yield _packed(docs, doc[first], place[first], hashes[first], np.empty(0, np.uint64), buckets, 64)
        if len(after):
            after = np.sort(after)
            yield _direct(docs, doc[after], place[after], buckets)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack(settle)
        for batch in batches:
            for part in slices(batch, "text"):
                words, begins = word_hashes(texts(part.column("text")))
                near = np.zeros(begins[-1] + 1, np.int32)
                for start, end, found in zip(begins[:-1], begins[1:], part.column("anchors").to_pylist(), strict=True):
                    if end - start < window:
                        continue
                    at = np.frombuffer(b"".join(found), np.int32)
                    at = at[at + window - PERIOD < end - start]
                    np.add.at(near, start + np.maximum(0, at - PERIOD + 1), 1)
                    np.add.at(near, start + np.minimum(at + 1, np.maximum(0, end - start - window + 1)), -1)
                doc, place, length = _positions(begins)
                at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (place + window <= length))
                ids = pc.fill_null(part.column("_order"), (1 << 63) - 1).to_numpy()
                docs = np.stack([part.column("_k1").to_numpy(), ids, part.column("_k2").to_numpy()], axis=1)
                yield from pack.add(docs, doc[at], place[at], run_hashes(words, window)[at])
        yield from pack.flush()

    return step


def _repeated_windows(group: pa.Table) -> pa.Table:
    """The entries of a bucket that are not the first of their hash."""
    docs, doc, place, origin, hashes, _ = _unpacked(group.filter(pc.invert(group.column("direct"))), 3, np.uint64)
    after = _later(docs, doc, place, hashes)[1] if len(hashes) else np.empty(0, np.int64)
    return _returned(group, docs, doc, place, origin, after)


def buckets_for(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """One for each `bucket_bytes` of all texts, and at least one for each partition of a shuffle."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))


def _ordered(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows of `keyed` with `_order`, a number in the order of doc_id and null for none.

    An integer is its own number. Ids of other types are sorted in ranges and
    numbered on from where a range begins, in a table, as ranges may differ if
    they are drawn again; with these the rows are shuffled once more.
    """
    if isinstance(keyed.schema["doc_id"].dataType, IntegralType):
        return rows.withColumn("_order", F.col("doc_id").cast("long"))
    ids = keyed.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct().orderBy("_id")
    numbered = written(ids.withColumn("_order", F.monotonically_increasing_id()), "substring-ids")
    return rows.join(numbered, rows.doc_id == numbered._id, "left").drop("_id")


def with_repeats(keyed: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`keyed` with `starts`, where the repeated windows of each document begin: arrays of (_k2, places).

    `keyed` has doc_id, the key of the row and text. A window is a repeat if
    the same words start earlier, by doc_id and place; a null id comes last.
    Ids may be of any type that has an order. Rows equal in id and text are one
    document, and rows that share an id only are compared by place. Windows are
    compared by 64 bits of hash and the bucket. The rows should be read from a
    table: a task that is run again has to see them in the same order. The
    texts are read once more to count their bytes.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    buckets = buckets_for(keyed, bucket_bytes)

    def settled(packed: DataFrame, name: str, settle: Callable[[pa.Table], pa.Table]) -> DataFrame:
        found = packed.groupBy("bucket").applyInArrow(settle, _RETURNED)
        by_document = found.groupBy("origin").applyInArrow(_by_document, _FLAGS)
        return by_document.groupBy("_k1").agg(F.collect_list(F.struct("_k2", "places")).alias(name))

    anchors = settled(keyed.select("_k1", "text").mapInArrow(_anchors(window, buckets), _PACKED), "anchors", _repeated_anchors)
    # The same columns by the same key in both joins: the texts are shuffled once.
    near = keyed.join(anchors.hint("merge"), "_k1").select("doc_id", "_k1", "_k2", "text", F.col("anchors.places").alias("anchors"))
    around = _ordered(near, keyed)
    starts = settled(around.mapInArrow(_windows(window, buckets), _PACKED), "starts", _repeated_windows)
    return keyed.join(starts.hint("merge"), "_k1", "left")


def _own(starts: list[dict] | None, k2: int) -> list[bytes]:
    return [s["places"] for s in starts or () if s["_k2"] == k2]


def kept_words(text: bytes, starts: list[bytes], window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words that no repeated window covers, and how many there are in all."""
    words = text.split()
    if not starts:
        return words, len(words)
    at = np.frombuffer(b"".join(starts), np.int32)
    change = np.zeros(len(words) + window + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    keep = np.cumsum(change)[: len(words)] == 0
    return [w for w, k in zip(words, keep, strict=True) if k], len(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the kept words as `text`, joined by a space, where words are removed; else as it was.

    All rows and columns stay. Null texts stay null.
    """
    joined = with_repeats(boxed(docs, "doc_id", *row_key("doc_id", "text"), "text"), window)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [texts(batch.column("text")), batch.column("starts").to_pylist(), batch.column("_k2").to_pylist()]
            cut = [
                b" ".join(kept_words(text, own, window)[0]).decode() if (own := _own(starts, k2)) else None
                for text, starts, k2 in zip(*columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cut, pa.string())], ["_row", "_cut"])

    cut = joined.mapInArrow(step, with_fields(joined.select("_row"), "_cut string"))
    return cut.select(F.col("_row").withField("text", F.coalesce("_cut", "_row.text")).alias("_row")).select("_row.*")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by a space, for each row of `docs`.

    A null text has no words. An empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = with_repeats(docs.select("doc_id", *row_key("doc_id", "text"), "text"), window)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [texts(batch.column("text")), batch.column("starts").to_pylist(), batch.column("_k2").to_pylist()]
            kept = [kept_words(text, _own(starts, k2), window) for text, starts, k2 in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for _, n in kept], pa.int64()),
                    pa.array([n - len(words) for words, n in kept], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(words)).hexdigest() for words, _ in kept], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return joined.mapInArrow(step, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
