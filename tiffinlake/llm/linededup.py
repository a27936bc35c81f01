"""Line dedup over range-partitioned hashes, with keep bitmaps instead of text.

Every line becomes 128 bits of hash with its document and position. The hashes
are range-partitioned together with the document, so that a line which half of
all documents hold is spread over many partitions, and sorted by document and
position within. A pass over a sorted partition sees each hash as one run: it
remembers the first occurrences only, and decides the rest as they stream by.
Runs at the ends of a partition may go on in the next one; these leave a sum
and their few undecided rows, which are settled together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiffinlake.llm.common import boxed, row_key, texts, with_fields, written

MIN_DOCS = 10
MIN_CHARS = 1

_LINES = "_k1 long, _k2 long, hi long, lo long, pos int"
_MARKS = "kind string, hi long, lo long, _k1 long, _k2 long, doc_id {id}, pos int, n long"


def key_of(line: bytes) -> bytes:
    """The line without white space (0x20, 0x09-0x0D) at its ends, A-Z in lower case."""
    return line.strip().lower()


def _hash_lines(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, digests = [], [], []
            for number, text in enumerate(texts(batch.column("text"))):
                for place, line in enumerate(text.split(b"\n")):
                    key = key_of(line)
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        row.append(number)
                        pos.append(place)
                        digests.append(hashlib.md5(key, usedforsecurity=False).digest())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            taken = batch.select(["doc_id", "_k1", "_k2"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(pos, pa.int32())],
                ["doc_id", "_k1", "_k2", "hi", "lo", "pos"],
            )

    return step


def _runs(min_docs: int, keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (hi, lo, document, pos): `drop` rows, and at both ends `sum`, `head` and `wait` rows.

    A run holds back the rows of its first `min_docs` - 1 documents at most.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = doc = head = None
        documents = 0
        first_run = True
        waiting: list[tuple] = []
        names = ["kind", "hi", "lo", "_k1", "_k2", "doc_id", "pos", "n"]
        out: list[tuple] = []
        schema: pa.Schema | None = None

        def close(edge: bool) -> None:
            if run is None:
                return
            if edge:
                out.append(("sum", *run, None, None, None, None, documents))
                if keep_first:
                    out.append(("head", *run, *head, None))
                out.extend(("wait", *run, *row, None) for row in waiting)

        def pack() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    zip(names, [pa.string(), *[pa.int64()] * 4, batch.schema.field("doc_id").type, pa.int32(), pa.int64()], strict=True)
                )
            columns = [batch.column(c).to_pylist() for c in ("hi", "lo", "_k1", "_k2", "doc_id", "pos")]
            for hi, lo, k1, k2, doc_id, pos in zip(*columns, strict=True):
                row = (k1, k2, doc_id, pos)
                if run != (hi, lo):
                    close(first_run)
                    first_run = run is None
                    run, doc, head, documents, waiting = (hi, lo), (k1, k2), row, 1, []
                elif doc != (k1, k2):
                    doc = (k1, k2)
                    documents += 1
                if documents < min_docs:
                    if not (keep_first and row == head):
                        waiting.append(row)
                    continue
                if waiting:
                    out.extend(("drop", *run, *w, None) for w in waiting)
                    waiting = []
                if not (keep_first and row == head):
                    out.append(("drop", *run, *row, None))
            if len(out) > 20_000:
                yield pack()
                out = []
        close(True)
        if schema is not None:
            yield pack()

    return step


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions to drop -> a compressed bitmap with a bit set for each line to keep, up to the last dropped one."""
    for batch in batches:
        bitmaps = []
        for positions in batch.column("positions").to_pylist():
            keep = np.ones(max(positions) + 1, bool)
            keep[positions] = False
            bitmaps.append(struct.pack("<I", len(keep)) + zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_k1"), batch.column("_k2"), pa.array([len(p) for p in batch.column("positions").to_pylist()], pa.int64()), pa.array(bitmaps, pa.binary())],
            ["_k1", "_k2", "n_dropped", "keep"],
        )


def kept_lines(text: bytes, bitmap: bytes | None) -> list[bytes]:
    """The lines that a bitmap keeps; those beyond its end are kept, and all without one."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines
    (size,) = struct.unpack_from("<I", bitmap)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), np.uint8), count=size)
    return [line for line, kept in zip(lines, keep, strict=False) if kept] + lines[size:]


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(_k1, _k2, n_dropped, keep) of the documents that lose lines.

    A line's key is the line stripped and in lower case (ASCII). Keys of at
    least `min_chars` code points that are in at least `min_docs` documents
    lose all their lines, or all but the first by doc_id and position if
    `keep_first`. A document is a row; rows equal in id and text are one. A
    null or empty text is one empty line.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = docs.select("doc_id", *row_key("doc_id", "text"), "text").mapInArrow(
        _hash_lines(min_chars), f"doc_id {kind}, {_LINES}"
    )
    # The last line of the sort lets a document that is there twice pass as one.
    order = ["hi", "lo", "doc_id", "_k1", "_k2"]
    marks = written(
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order, "pos")
        .mapInArrow(_runs(min_docs, keep_first), _MARKS.format(id=kind)),
        "line-marks",
    )
    edges = marks.where("kind <> 'drop'")
    common = edges.where("kind = 'sum'").groupBy("hi", "lo").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
    settled = edges.where("kind = 'wait'").join(common, ["hi", "lo"], "left_semi").select("_k1", "_k2", "pos")
    if keep_first:
        nth = F.row_number().over(Window.partitionBy("hi", "lo").orderBy("doc_id", "_k1", "_k2", "pos"))
        later = edges.where("kind = 'head'").join(common, ["hi", "lo"], "left_semi").withColumn("nth", nth)
        settled = settled.unionByName(later.where("nth > 1").select("_k1", "_k2", "pos"))
    return (
        marks.where("kind = 'drop'")
        .select("_k1", "_k2", "pos")
        .unionByName(settled)
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("pos").alias("positions"))
        .mapInArrow(_pack, "_k1 long, _k2 long, n_dropped long, keep binary")
    )


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Joins `_n_dropped` and `_keep` to rows that have their key, null where nothing is dropped."""
    found = bitmaps.withColumnsRenamed({"n_dropped": "_n_dropped", "keep": "_keep"})
    return docs.join(found.hint("shuffle_hash"), ["_k1", "_k2"], "left").drop("_k1", "_k2")


def drop_common_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with their common lines gone from `text`, and `n_chars`, if there, counted anew.

    All rows and columns stay; a text that loses all its lines is empty, and a
    null one stays null. Options as in `keep_bitmaps`.
    """
    keyed = boxed(docs, *row_key("doc_id", "text"), "text")
    joined = with_bitmaps(keyed, keep_bitmaps(docs, **options))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [
                None if bitmap is None else b"\n".join(kept_lines(text, bitmap)).decode()
                for text, bitmap in zip(texts(batch.column("text")), batch.column("_keep").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cut, pa.string())], ["_row", "_cut"])

    cut = joined.mapInArrow(step, with_fields(joined.select("_row"), "_cut string"))
    text = F.coalesce("_cut", "_row.text")
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return cut.select(row.alias("_row")).select("_row.*")


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept, for each row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", *row_key("doc_id", "text"), "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column("text"))
            kept = [kept_lines(t, b) for t, b in zip(whole, batch.column("_keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([t.count(b"\n") + 1 for t in whole], pa.int64()),
                    pc.fill_null(batch.column("_n_dropped"), 0),
                    pa.array([hashlib.sha256(b"\n".join(lines)).hexdigest() for lines in kept], pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return with_bitmaps(narrow, keep_bitmaps(narrow, **options)).mapInArrow(
        step, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string"
    )
