"""Vectors as short codes: each part of a vector by the index of the nearest entry of the part's codebook.

All arithmetic is on integers. Parts and entries, padded with zeros to a power
of two, go through an integer Walsh-Hadamard transform, which multiplies every
squared distance by its size. Coefficients are taken in sequency order, slow
patterns before fast ones: the first already gives a bound from the entry that
looks nearest, and an entry whose sum of squares so far is beyond the bound is
out, long before all coefficients are added. What is left has its exact
distance. Where 64 bits could overflow, the same steps run on Python integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tiffinlake.llm.common import written

#: Parts of a vector, entries of a codebook, rounds of learning, integer steps in 1.0.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a step in numpy takes at a time.
ROWS = 4096
#: Sums travel as signed digits of so many bits.
DIGIT_BITS = 60
_LONG = (1 << 63) - 1


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: 64-bit integers, or Python's if one does not fit."""
    if not values.size or np.abs(values).max() < (1 << 52) / scale:
        return np.floor(values * scale).astype(np.int64)
    flat = [math.floor(v * scale) if abs(v) < (1 << 52) / scale else math.floor(scale * _exact(v)) for v in values.ravel()]
    return np.array(flat, object).reshape(values.shape)


def _exact(value: float) -> int | float:
    """A double beyond 2**52 is a whole number; a smaller one loses nothing when scaled by a power of two."""
    return int(value) if abs(value) >= 1 << 52 else value


def sequency(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by how often their sign changes."""
    bits = size.bit_length() - 1
    gray = (s ^ (s >> 1) for s in range(size))
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, zeros put behind it up to a power of two, in sequency order."""
    size = 1 << max(0, x.shape[-1] - 1).bit_length()
    out = np.zeros((*x.shape[:-1], size), x.dtype)
    out[..., : x.shape[-1]] = x
    half = 1
    while half < size:
        pairs = out.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        first, second = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([first + second, first - second], axis=-2).reshape(*x.shape[:-1], size)
        half *= 2
    return out[..., sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the smaller one of equals, and its scaled distance; both sides transformed.

    Only sums of some coefficients are compared with the bound, and they can
    but grow: no entry that could win is ever dropped.
    """
    size = parts.shape[1]
    sums = (parts[:, None, 0] - entries[None, :, 0]) ** 2
    likely = entries[np.argmin(sums, axis=1)]
    bound = ((parts - likely) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    done = 1
    while done < size:
        more = slice(done, 2 * done)
        sums = sums + ((parts[row, more] - entries[entry, more]) ** 2).sum(axis=1)
        open_ = sums <= bound[row]
        row, entry, sums = row[open_], entry[open_], sums[open_]
        done *= 2
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(sums, starts)
    winners = np.flatnonzero(sums == best[row])
    _, first = np.unique(row[winners], return_index=True)
    return entry[winners[first]], best


@dataclass
class Codebooks:
    """`entries` (part, entry, position) as integers; vectors have `length` components."""

    entries: np.ndarray
    length: int
    scale: int = SCALE

    def __post_init__(self) -> None:
        self.parts, self.count, self.width = self.entries.shape
        self.size = 1 << max(0, self.width - 1).bit_length()
        self.transformed = walsh(self.entries) if self.width else self.entries
        # Components up to this keep each sum of squares within 64 bits.
        self.most = math.isqrt((1 << 61) // (self.parts * self.size**2)) // 2

    def _fits(self, values: np.ndarray) -> bool:
        return values.dtype != object and (not values.size or int(np.abs(values).max()) <= self.most)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row, part) of integer vectors, and the sum over parts of their squared distances."""
        rows = len(vectors)
        codes = np.zeros((rows, self.parts), np.int64)
        if not self.width:
            return codes, np.zeros(rows, np.int64)
        exact = object if not (self._fits(vectors) and self._fits(self.entries)) else np.int64
        parts = walsh(vectors.astype(exact).reshape(rows, self.parts, self.width))
        books, error = self.transformed.astype(exact), np.zeros(rows, exact)
        for part in range(self.parts):
            codes[:, part], far = nearest(parts[:, part], books[part])
            error = error + far // self.size
        return codes, error

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (row, part) stand for, as doubles at the middle of an integer step."""
        picked = self.entries[np.arange(self.parts), codes].reshape(len(codes), self.length)
        return (picked.astype(np.float64) + 0.5) / self.scale

    def sha256(self) -> str:
        """Lowercase hex, over all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | None = None) -> DataFrame:
    """(vec_id, vector, label) of the rows whose vector is not null and holds neither null nor non-finite components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select(
        F.col(id_column).alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
        (F.lit(None) if label is None else label).alias("label"),
    )
    return named.where(F.col("vector").isNotNull() & finite)


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The vectors of a batch, all of that length."""
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks | None:
    """Entries from the vectors of the smallest ids (equal ids by vector, null ids last); None if there is no vector.

    The first of them sets the length; it must be a multiple of `parts`.
    """
    first = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    alike = np.array([r["vector"] for r in first if len(r["vector"]) == length], np.float64)
    return Codebooks(integers(alike, scale).reshape(len(alike), parts, length // parts).swapaxes(0, 1).copy(), length, scale)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """A number as signed digits, lowest first."""
    left, place = abs(value), 0
    while left or not place:
        yield place, (left & ((1 << DIGIT_BITS) - 1)) * (-1 if value < 0 else 1)
        left >>= DIGIT_BITS
        place += 1


def _sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, position, digit, total): what each task adds up over its vectors, per entry, summed.

    Position -1 has the counts. Each task sends a row per component of the
    codebooks at most, however many vectors it has.
    """
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        totals = np.zeros(known.entries.shape, object)
        counts = np.zeros(known.entries.shape[:2], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                vectors = integers(_matrix(batch.slice(at, ROWS), known.length), known.scale)
                codes, _ = known.assign(vectors)
                cut = vectors.reshape(len(vectors), known.parts, known.width)
                # A sum over so few rows fits wherever the rows themselves fit.
                some = np.zeros(known.entries.shape, cut.dtype if known._fits(vectors) else object)
                for part in range(known.parts):
                    np.add.at(some[part], codes[:, part], cut[:, part])
                    counts[part] += np.bincount(codes[:, part], minlength=known.count)
                totals += some
        rows = [(*at, -1, 0, int(n)) for at, n in np.ndenumerate(counts) if n]
        for at, total in np.ndenumerate(totals):
            if counts[at[:2]]:
                rows.extend((*at, place, digit) for place, digit in _digits(int(total)))
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(),) * 4 + (pa.int64(),), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "digit", "total"])

    alike = kept.where(F.size("vector") == books.length).select("vector")
    partial = alike.mapInArrow(step, "part int, entry int, position int, digit int, total long")
    return partial.groupBy("part", "entry", "position", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry the componentwise floor of the mean of the parts assigned to it; unused ones stay.

    What comes to the driver is of the size of the codebooks.
    """
    sums: dict[tuple[int, int, int], int] = {}
    for part, entry, position, digit, total in _sums(kept, books).collect():
        key = part, entry, position
        sums[key] = sums.get(key, 0) + (int(total) << (DIGIT_BITS * digit))
    entries = books.entries.astype(object)
    for (part, entry, position), total in sums.items():
        if position >= 0:
            entries[part, entry, position] = total // sums[part, entry, -1]
    fits = not entries.size or max(map(abs, entries.ravel().tolist())) <= _LONG
    return Codebooks(entries.astype(np.int64) if fits else entries, books.length, books.scale)


def train(kept: DataFrame, rounds: int = ROUNDS, **options) -> Codebooks | None:
    """Codebooks of the usable vectors after some rounds over all of them."""
    books = first_codebooks(kept, **options)
    for _ in range(rounds if books else 0):
        books = improved(kept, books)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of usable vectors.

    `code` is two hex digits a part. A vector of another length has neither; an
    error beyond 64 bits is null.
    """
    shared = kept.sparkSession.sparkContext.broadcast(books)
    names = ["vec_id", "label", "code", "error"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                alike = np.flatnonzero(rows.column("vector").value_lengths().to_numpy() == known.length)
                codes, errors = known.assign(integers(_matrix(rows.take(pa.array(alike)), known.length), known.scale))
                hexes, far = [None] * rows.num_rows, [None] * rows.num_rows
                for i, code, error in zip(alike.tolist(), codes.astype(np.uint8), errors.tolist(), strict=True):
                    hexes[i], far[i] = code.tobytes().hex(), error if error <= _LONG else None
                columns = [rows.column("vec_id"), rows.column("label"), pa.array(hexes, pa.string()), pa.array(far, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [kept.schema["vec_id"], kept.schema["label"], StructField("code", StringType()), StructField("error", LongType())]
    return kept.mapInArrow(step, StructType(kinds))


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of `vectors`.

    Vectors that are null or hold null or non-finite components are left out.
    Codebooks have at most 256 entries; they start from the smallest ids, equal
    ids by vector and null ids last, so from fewer if there are fewer, and have
    the length of the first of these. A vector of another length counts for
    nothing and has null for code and error; a length that the parts do not
    divide is an error. `label_error` sums the errors of equal labels, null
    being one label; equal rows each count. Errors are null beyond 64 bits. An
    empty table gives an empty one.
    """
    if options.get("entries", ENTRIES) > 256:
        raise ValueError("two hex digits a part name 256 entries at most")
    kept = usable(vectors, id_column, vector_column, F.col(label_column))
    books = train(kept, **options)
    if books is None:
        books = Codebooks(np.zeros((1, 1, 0), np.int64), 0)
    # Read twice, for the sums and for the rows.
    coded = written(encode(kept, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")
    sums = coded.groupBy(F.col("label").alias("_of")).agg(total)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
