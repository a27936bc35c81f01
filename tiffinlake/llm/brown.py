"""A class-based bigram model of words, its classes found by exchange.

A word is emitted by its class, and classes follow each other: the probability
of a text is the product of class transitions and word emissions. The exchange
moves each word to the class that raises the likelihood of the class bigrams
most. A word is judged by the classes of its neighbours on both sides, counted
over all training texts: in the first pass by a class of their form, in the
next by the class that the exchange gave them, as far as they are frequent.

Words are known by 64 bits. The vocabulary is a table of packed rows, one for
each range of hashes, as many as the size of the texts asks for; a word and its
counts lie in one of them. To read texts, they are dealt to units of bounded
size; a unit asks each range for its own words, once however often they occur,
and gets their counts and classes. Only matrices of classes and a list of
frequent words of a fixed length ever come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tiffinlake.llm.common import slices, texts, written
from tiffinlake.llm.langid import held_out
from tiffinlake.llm.words import hashes_between, mixed, word_hashes, word_places
from tiffinlake.session import remove, scratch_dir

#: Classes of words; also classes of forms, which words start from.
CLASSES = 60
#: Times that neighbours are counted, and rounds of exchange after each; steps in a round, some.
PASSES, ROUNDS, STEPS = 2, 2, 64
#: Words whose classes travel with the tasks that count neighbours, at most.
FREQUENT = 1 << 16
#: Bytes of text to a range of the vocabulary and to a unit of reading, some.
RANGE_BYTES, UNIT_BYTES = 8 << 20, 8 << 20
#: Bytes of text that neighbours are counted in at a time; bytes of text, or words of classes, that are read at a time.
SLICE, READ_SLICE = 4 << 20, 1 << 20
#: Weight of the class frequencies in a transition, as so many words seen.
SMOOTHING = 16.0

#: Neighbours of a word on one side: classes, classes of forms, the end of a text.
_AROUND = 2 * CLASSES + 1
_END_OF_TEXT = _AROUND - 1
_IDS = 2 * _AROUND
_CELLS = _IDS * CLASSES
#: In a text's classes: a word that training saw once, and a word that it never saw.
_ONCE, _UNSEEN = 0x80, 0xFF
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MARK = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_PACKED = "bucket int, words binary, counts binary, classes binary, sizes binary, ids binary, values binary"
_NAMES = [f.split()[0] for f in _PACKED.split(", ")]
#: Numbers in the bytes of a whole range, and of what a slice of text adds to one.
_KINDS = (np.uint64, np.uint64, np.uint8, np.uint8, np.uint8, np.uint64)
_PART_KINDS = (np.uint64, np.uint32, np.uint8, np.uint8, np.uint8, np.uint32)
#: Counts of one word beyond this are looked at one by one in an exchange.
_SMALL = 8


def lowered(values: list[bytes]) -> list[bytes]:
    return [v.translate(_LOWER) for v in values]


def forms(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A class for each word from its last two bytes, leaving out one mark at the end."""
    codes = np.frombuffer(buffer, np.uint8)
    ends = ends - (_MARK[codes[ends - 1]] & (ends - starts > 1))
    last, before = codes[ends - 1].astype(np.uint64), codes[np.maximum(ends - 2, starts)].astype(np.uint64)
    return (mixed(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(CLASSES)).astype(np.uint8)


def ranges_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """Which range of the vocabulary a hash is in; ranges rise with the hash."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _array(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The numbers of all rows of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


@dataclass
class Frequent:
    """Hashes of frequent words in order, and their classes."""

    words: np.ndarray
    classes: np.ndarray

    def find(self, words: np.ndarray, otherwise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, or what `otherwise` says; and which ones are known."""
        if not len(self.words):
            return otherwise, np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return np.where(known, self.classes[at], otherwise).astype(np.uint8), known


def neighbours(values: list[bytes], frequent: Frequent, buckets: int) -> Iterator[tuple]:
    """Packed rows of the words of some texts: count, class to start from, and counts of neighbours by side and class."""
    buffer, starts, ends, begins = word_places(values)
    if not len(starts):
        return
    words, first, owner = np.unique(hashes_between(buffer, starts, ends), return_index=True, return_inverse=True)
    classes, known = frequent.find(words, forms(buffer, starts[first], ends[first]))
    counts = np.bincount(owner)
    kind = np.int32 if len(words) * _IDS < 1 << 31 else np.int64
    around, owner = np.where(known, classes, classes + CLASSES).astype(kind)[owner], owner.astype(kind) * kind(_IDS)
    filled = begins[:-1] < begins[1:]
    keys = np.empty(2 * len(owner), kind)
    left, right = keys[: len(owner)], keys[len(owner) :]
    left[1:], left[begins[:-1][filled]] = around[:-1], _END_OF_TEXT
    right[:-1], right[begins[1:][filled] - 1] = around[1:], _END_OF_TEXT
    right += kind(_AROUND)
    left += owner
    right += owner
    keys.sort()
    edges = np.flatnonzero(np.diff(keys, prepend=-1))
    values_, keys = np.diff(edges, append=len(keys)), keys[edges]
    yield from _pack(words, counts, classes, np.bincount(keys // _IDS), keys % _IDS, values_, buckets)


def _pack(words: np.ndarray, counts: np.ndarray, classes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, values: np.ndarray, buckets: int):
    at = np.concatenate(([0], np.cumsum(sizes)))
    place = ranges_of(words, buckets)
    edges = np.flatnonzero(np.diff(place, prepend=-1, append=buckets))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        some = slice(int(at[lo]), int(at[hi]))
        pieces = words[lo:hi], counts[lo:hi], classes[lo:hi], sizes[lo:hi], ids[some], values[some]
        yield int(place[lo]), *(a.astype(k).tobytes() for a, k in zip(pieces, _PART_KINDS, strict=True))


@dataclass
class Range:
    """One range of the vocabulary; `owner` says whose the counts of neighbours are."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        self.sizes = self.sizes.astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.words)), self.sizes)

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, kinds: tuple = _KINDS) -> Range:
        return cls(*(_array(table.column(c), k) for c, k in zip(_NAMES[1:], kinds, strict=True)))

    def merged(self) -> Range:
        """The same with each word once, in the order of hashes."""
        words, first, place = np.unique(self.words, return_index=True, return_inverse=True)
        counts = _added(place, self.counts, len(words))
        keys, at = np.unique(place[self.owner] * _IDS + self.ids, return_inverse=True)
        values = _added(at, self.values, len(keys))
        return Range(words, counts, self.classes[first], np.bincount(keys // _IDS, minlength=len(words)), keys % _IDS, values)

    def totals(self) -> np.ndarray:
        """Counts of (neighbour, class), then words, and words seen once."""
        cells = self.ids.astype(np.int64) * CLASSES + self.classes[self.owner]
        return np.concatenate((_added(cells, self.values, _CELLS), [len(self.words), int((self.counts == 1).sum())])).astype(np.int64)

    def exchanged(self, totals: np.ndarray, ranges: int = 1, steps: int = STEPS) -> np.ndarray:
        """Classes after each word, the most frequent first, has gone to where the likelihood of class bigrams is highest.

        That is the sum of f(n) over counts of (neighbour, class) less twice
        that over classes, f(n) being n log n; a word is first taken out of its
        own class. Words move in steps of a small share of the words or of
        their occurrences, and each step sees what the ones before it did. As
        hashes deal words to ranges by chance, the other ranges will do the same
        at the same time: what rare words do counts for all ranges.
        """
        cells = totals[:_CELLS].reshape(_IDS, CLASSES).astype(np.float64)
        classes = self.classes.copy()
        order = np.lexsort((self.words, -self.counts.astype(np.int64)))
        mass = np.cumsum(self.counts[order].astype(np.float64))
        step = np.floor(steps * mass / mass[-1]) + np.arange(len(order)) * steps // len(order)
        likely = np.clip(mass[-1] * ranges / (1000.0 * self.counts.astype(np.float64)), 1, ranges)
        ends = np.cumsum(self.sizes)
        for some in np.split(order, np.flatnonzero(np.diff(step)) + 1):
            size = self.sizes[some]
            begins = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.arange(size.sum()) + np.repeat(ends[some] - size - begins, size)
            ids, values, own = self.ids[at].astype(np.int64), self.values[at].astype(np.int64), np.repeat(classes[some], size)
            sizes = cells[:_AROUND].sum(axis=0)
            if len(at) > 4 * _IDS:
                more = _more(cells[None], np.arange(1, _SMALL + 1, dtype=np.float64)[:, None, None]).astype(np.float32)
                gain = more[np.minimum(values, _SMALL) - 1, ids]
                large = np.flatnonzero(values > _SMALL)
                gain[large] = _more(cells[ids[large]], values[large, None].astype(np.float64))
            else:
                gain = _more(cells[ids], values[:, None].astype(np.float64))
            gain[np.arange(len(at)), own] = _more(cells[ids, own] - values, values.astype(np.float64))
            count, rows = self.counts[some].astype(np.float64), np.arange(len(some))
            sums = np.add.reduceat(gain, begins, axis=0, dtype=np.float64) - 2 * _more(sizes[None, :], count[:, None])
            stay = classes[some]
            sums[rows, stay] += 2 * (_more(sizes[stay], count) - _more(sizes[stay] - count, count))
            best = sums.argmax(axis=1)
            classes[some] = np.where(sums[rows, best] > sums[rows, stay] + 1e-3, best, stay)
            weights = values * np.repeat(likely[some], size)
            going = np.bincount(ids * CLASSES + np.repeat(classes[some], size), weights, _CELLS) - np.bincount(ids * CLASSES + own, weights, _CELLS)
            cells = np.maximum(cells + going.reshape(cells.shape), 0)
        return classes

    def row(self, bucket: int, classes: np.ndarray | None = None) -> pa.RecordBatch:
        kept = self if classes is None else Range(self.words, self.counts, classes, self.sizes, self.ids, self.values)
        columns = [
            pa.array([bucket], pa.int32()),
            *(
                pa.array([a.astype(k).tobytes()], pa.binary())
                for a, k in zip((kept.words, kept.counts, kept.classes, kept.sizes, kept.ids, kept.values), _KINDS, strict=True)
            ),
            pa.array([kept.totals().tolist()], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [*_NAMES, "totals"])


def _added(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place, exact below 2**53."""
    return np.bincount(place, weights=values.astype(np.float64), minlength=size).astype(np.uint64)


def _more(have: np.ndarray, add: np.ndarray) -> np.ndarray:
    """f(have + add) - f(have) for f(n) = n log n, f(0) = 0."""
    have = np.maximum(have, 0)
    total = have + add
    return total * np.log(np.maximum(total, 1)) - have * np.log(np.maximum(have, 1))


def _summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of an array of numbers that each gives: one a task, added up by place."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += of(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["place", "total"])

    out = np.zeros(size, np.int64)
    for place, total in rows.mapInArrow(step, "place int, total long").groupBy("place").agg(F.sum("total")).collect():
        out[place] = total
    return out


@dataclass
class Vocabulary:
    """`rows` are packed ranges with counts and classes; `totals` what all of them add up to."""

    rows: DataFrame
    path: str
    buckets: int
    documents: int
    totals: np.ndarray

    @property
    def class_tokens(self) -> np.ndarray:
        return self.totals[:_CELLS].reshape(_IDS, CLASSES)[:_AROUND].sum(axis=0)

    @property
    def tokens(self) -> int:
        """Words and ends of training texts."""
        return int(self.class_tokens.sum()) + self.documents

    @property
    def types(self) -> int:
        """Distinct tokens, the end among them if there is one."""
        return int(self.totals[_CELLS]) + (self.documents > 0)

    @property
    def once(self) -> int:
        return int(self.totals[_CELLS + 1])


def _kept(rows: DataFrame, buckets: int, documents: int, old: str | None = None) -> Vocabulary:
    """The rows as a table of their own; the table that they were made from goes."""
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, "vocabulary")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    size = _CELLS + 2
    totals = _summed(rows.select("totals"), lambda batch: batch.column(0).flatten().to_numpy().reshape(-1, size).sum(axis=0), size)
    if old:
        remove(spark, old)
    return Vocabulary(rows.drop("totals"), path, buckets, documents, totals)


def _counted(train: DataFrame, frequent: Frequent, buckets: int, documents: int) -> Vocabulary:
    """The vocabulary of texts, with the neighbours of each word.

    A task adds up what is equal in some megabytes of text before anything is
    shuffled: a word has one entry per slice, however frequent it is.
    """
    shared = train.sparkSession.sparkContext.broadcast(frequent)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = list(neighbours(lowered(texts(part.column("text"))), shared.value, buckets))
                if rows:
                    kinds = (pa.int32(), *(pa.binary(),) * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Range.of(group, _PART_KINDS).merged().row(key[0].as_py())])

    parts = train.select("text").mapInArrow(step, _PACKED)
    return _kept(parts.groupBy("bucket").applyInArrow(merge, f"{_PACKED}, totals array<long>"), buckets, documents)


def _exchange(known: Vocabulary) -> Vocabulary:
    ranges = known.buckets
    shared = known.rows.sparkSession.sparkContext.broadcast(known.totals)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                one = Range.of(row)
                yield one.row(row.column("bucket")[0].as_py(), one.exchanged(shared.value, ranges))

    rows = known.rows.mapInArrow(step, f"{_PACKED}, totals array<long>")
    return _kept(rows, known.buckets, known.documents, known.path)


def _frequent(known: Vocabulary, most: int) -> Frequent:
    """The most frequent words and their classes, no more than `most`: all whose count is beyond a limit.

    Limits are a sixteenth of an octave apart; how many words are beyond each
    is counted first.
    """

    def level(counts: np.ndarray) -> np.ndarray:
        return (16 * np.log2(counts.astype(np.float64))).astype(np.int64)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        return np.bincount(level(_array(batch.column("counts"), np.uint64)), minlength=1024)

    levels = _summed(known.rows.select("counts"), count, 1024)
    beyond = np.cumsum(levels[::-1])[::-1]
    limit = int(np.argmax(beyond <= most))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, classes = _array(batch.column("words"), np.uint64), _array(batch.column("classes"), np.uint8)
            some = level(_array(batch.column("counts"), np.uint64)) >= limit
            yield pa.RecordBatch.from_arrays([pa.array(words[some].view(np.int64)), pa.array(classes[some].astype(np.int32))], ["word", "class"])

    rows = known.rows.select("words", "counts", "classes").mapInArrow(choose, "word long, class int").collect()
    words = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return Frequent(words[order], np.array([r[1] for r in rows], np.uint8)[order])


def cluster(train: DataFrame, passes: int = PASSES, rounds: int = ROUNDS, range_bytes: int = RANGE_BYTES, frequent: int = FREQUENT) -> Vocabulary:
    """The vocabulary of the column `text` with the classes that the exchange ends with."""
    size, documents = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-size // range_bytes))
    known = _counted(train, Frequent(np.empty(0, np.uint64), np.empty(0, np.uint8)), buckets, documents)
    for n in range(passes):
        if n:
            words = _frequent(known, frequent)
            remove(train.sparkSession, known.path)
            known = _counted(train, words, buckets, documents)
        for _ in range(rounds):
            known = _exchange(known)
    return known


_LOOKED_UP = "unit int, words binary, counts binary, classes binary"


def read_texts(docs: DataFrame, known: Vocabulary, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emission and classes of (doc_id, held_out, text).

    `classes` has a byte for each word of a text; `emission` is the sum of the
    logarithms of the words' shares of their classes. A unit takes part as one
    group, of so many bytes on average, or of its longest text.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, units = known.buckets, max(1, -(-size // unit_bytes))
    tokens, types, ends = known.tokens, known.types, known.documents
    log_share = np.log10(np.maximum(known.class_tokens, 1).astype(np.float64))

    def ask(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        words = [np.unique(word_hashes(lowered(texts(chunk)))[0]) for chunk in group.column("text").chunks]
        words = np.unique(np.concatenate([np.empty(0, np.uint64), *words]))
        place = ranges_of(words, buckets)
        edges = np.flatnonzero(np.diff(place, prepend=-1, append=buckets))
        rows = [(int(place[lo]), words[lo:hi].tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)] if len(words) else []
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            ["bucket", "unit", "words"],
        )

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, found: pa.Table) -> pa.Table:
        words, counts, classes = (_array(found.column(c), k) for c, k in (("words", np.uint64), ("counts", np.uint64), ("classes", np.uint8)))
        out = [], []
        for row in asked.column("words").to_pylist():
            wanted = np.frombuffer(row, np.uint64)
            if len(words):
                at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
                seen = words[at] == wanted
                out[0].append(np.where(seen, counts[at], 0).astype(np.uint64).tobytes())
                out[1].append(np.where(seen, classes[at], 0).astype(np.uint8).tobytes())
            else:
                out[0].append(bytes(8 * len(wanted)))
                out[1].append(bytes(len(wanted)))
        columns = [asked.column("unit"), asked.column("words"), *(pa.array(o, pa.binary()) for o in out)]
        return pa.table(columns, ["unit", "words", "counts", "classes"])

    def read(key: tuple[pa.Scalar, ...], group: pa.Table, answers: pa.Table) -> pa.Table:
        words, counts, classes = (_array(answers.column(c), k) for c, k in (("words", np.uint64), ("counts", np.uint64), ("classes", np.uint8)))
        order = np.argsort(words)
        words, counts, classes = words[order], counts[order].astype(np.int64), classes[order]
        base = np.log10((counts + 1) / (tokens + types + 1))
        share = np.log10(np.maximum(counts, 1)) - log_share[classes]
        share[counts == 0] = 0
        codes = np.where(counts == 0, _UNSEEN, classes | np.where(counts == 1, _ONCE, 0)).astype(np.uint8)
        end = np.log10((ends + 1) / (tokens + types + 1))
        out = []
        for batch in group.to_batches():
            for part in slices(batch, "text", READ_SLICE):
                hashes, begins = word_hashes(lowered(texts(part.column("text"))))
                at = np.searchsorted(words, hashes)
                seen = np.concatenate(([0], np.cumsum(counts[at] > 0)))
                seen = seen[begins[1:]] - seen[begins[:-1]]
                scores = [np.zeros(part.num_rows), np.zeros(part.num_rows)]
                filled = np.flatnonzero(begins[:-1] < begins[1:])
                if len(filled):
                    for total, v in zip(scores, (base, share), strict=True):
                        total[filled] = np.add.reduceat(v[at], begins[:-1][filled])
                line = codes[at].tobytes()
                lines = [line[b:e] for b, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                columns = [
                    part.column("doc_id"), part.column("held_out"), pa.array(np.diff(begins) + 1), pa.array(seen + (ends > 0)),
                    pa.array(scores[0] + end), pa.array(scores[1]), pa.array(lines, pa.binary()),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, read_schema.names))
        return pa.Table.from_batches(out)

    read_schema = StructType(
        [
            StructField("doc_id", docs.schema["doc_id"].dataType),
            StructField("held_out", BooleanType()),
            *StructType.fromDDL("n_tokens long, n_known long, base_score double, emission double, classes binary").fields,
        ]
    )
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int").alias("unit")
    dealt = docs.select(unit, "doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    asked = dealt.groupBy("unit").applyInArrow(ask, "bucket int, unit int, words binary")
    stored = known.rows.select("bucket", "words", "counts", "classes")
    answers = asked.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(answer, _LOOKED_UP)
    return dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(read, read_schema)


#: States of the chain: classes, the end of a text, an unseen word.
END, UNSEEN, STATES = CLASSES, CLASSES + 1, CLASSES + 2


def _states(line: np.ndarray) -> np.ndarray:
    return np.where(line == _UNSEEN, UNSEEN, line & (_ONCE - 1)).astype(np.int16)


def _chain(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State before, state, whether a word seen once, and row of each token of some texts; the end comes before and after each."""
    lines = batch.column("classes").to_pylist()
    # 0xFE stands for an end; no word has it.
    line = np.frombuffer(b"".join(b"\xfe" + x for x in lines) + b"\xfe", np.uint8)
    states = np.where(line == 0xFE, np.int16(END), _states(line))
    once = (line[1:] & _ONCE > 0) & (line[1:] < 0xFE)
    lengths = np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines))
    return states[:-1], states[1:], once, np.repeat(np.arange(len(lines)), lengths)


def transitions(read: DataFrame) -> np.ndarray:
    """Counts of (state before, state) over texts that `read_texts` gave; a word seen once counts for UNSEEN as well."""
    size = STATES * STATES

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for part in slices(batch, "classes", READ_SLICE):
            before, state, once, _ = _chain(part)
            total += np.bincount(before * STATES + state, minlength=size)
            total += np.bincount(before[once] * STATES + UNSEEN, minlength=size)
        return total

    return _summed(read.select("classes"), count, size).reshape(STATES, STATES)


def log_chain(counts: np.ndarray, known: Vocabulary, smoothing: float = SMOOTHING) -> np.ndarray:
    """log10 P(state | state before), drawn to the frequency of the state; each row sums to 1 over what can occur.

    An unseen word is as likely as a word seen once was; all unseen words are
    one, as they are in the base score. Without a training text the end is an
    unseen word too.
    """
    share = np.concatenate((known.class_tokens, [known.documents], [known.once + 1])).astype(np.float64)
    share /= share.sum()
    chain = (counts + smoothing * share) / (counts.sum(axis=1, keepdims=True) + smoothing)
    if not known.documents:
        chain[:, END] = chain[:, UNSEEN]
    return np.log10(np.maximum(chain, np.finfo(float).tiny))


def scored(read: DataFrame, chain: np.ndarray, known: Vocabulary) -> DataFrame:
    """What `read_texts` gave, with the score of each text in place of its classes."""
    kept = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    tokens = known.tokens

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "classes", READ_SLICE)):
            before, state, _, row = _chain(part)
            score = np.bincount(row, weights=chain[before, state], minlength=part.num_rows) + part.column("emission").to_numpy()
            words = part.column("n_tokens").to_numpy()
            columns = [part.column(c) for c in kept[:4]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(part.num_rows, tokens)), part.column("base_score"), pa.array(score), pa.array(10 ** np.minimum(300.0, -score / words))],
                [*kept[:4], "train_tokens", "base_score", "score", "perplexity"],
            )

    fields = {f.name: f for f in read.schema.fields}
    more = StructType.fromDDL("train_tokens long, base_score double, score double, perplexity double").fields
    return read.mapInArrow(step, StructType([*(fields[c] for c in kept[:4]), *more]))


def score(docs: DataFrame, held: Column | None = None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of all of `docs`.

    Learned from the rows that are not held out (`held`; by default those whose
    crc32 of the id modulo 7 is 2, a null id being learned from). A text that is
    null, empty or of spaces has one token, its end. Rows that repeat are learned
    from and scored each; other columns, whatever their names, have no part. An
    empty table gives an empty one; without a row to learn from every token is
    unseen and all scores are 0.
    """
    unit_bytes = options.pop("unit_bytes", UNIT_BYTES)
    marked = docs.select("doc_id", (held_out(7, 2) if held is None else held).alias("held_out"), "text")
    known = cluster(marked.where("NOT held_out").select("text"), **options)
    read = written(read_texts(marked, known, unit_bytes), "read")
    chain = log_chain(transitions(read.where("NOT held_out")), known)
    return scored(read, chain, known)
