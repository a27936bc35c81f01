"""Quality of documents: random-indexing word vectors, pooled, and a small network with calibrated probabilities.

A token is a run of letters, of digits or of other characters. Each has a
sparse random index vector, and its word vector is the sum of those of the
tokens around it over all texts: one pass, whose sums Spark adds up. Tokens
share a fixed number of slots by hash, so that the vectors have a known size. A
document is the mean and the spread of its vectors and how far each is from the
next; a network of two layers, fitted on a bounded sample of labelled rows,
scores it, and a temperature fitted on rows apart makes the score a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffinlake.llm.common import sampled, slices, texts, written
from tiffinlake.llm.langid import held_out
from tiffinlake.llm.words import hashes_between

SLOTS, DIMENSIONS, ONES = 1 << 15, 32, 4
FEATURES = 3 * DIMENSIONS
#: Tokens before and after that count as around.
AROUND = 2
#: A word vector of few tokens is drawn to the mean of all as by so many of them.
PRIOR = 20.0
#: Labelled rows that the network is fitted on at most, one in five of them for the temperature.
MOST_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.01, 1e-3
THRESHOLD = 0.3
#: Bytes of text per step: a matrix of as many rows as tokens stays small.
_STEP_BYTES = 1 << 20

_KIND = np.ones(256, np.uint8) * 4
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 2
_KIND[0x30:0x3A] = 3


def index_vectors() -> np.ndarray:
    """(SLOTS + 1, DIMENSIONS): half the ONES of a slot are 1, half are -1; the last row is zero."""
    random = np.random.default_rng(8)
    out = np.zeros((SLOTS + 1, DIMENSIONS), np.float32)
    places = np.argsort(random.random((SLOTS, DIMENSIONS)), axis=1)[:, :ONES]
    out[np.arange(SLOTS)[:, None], places] = np.where(np.arange(ONES) % 2, -1, 1)
    return out


def slots_of(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the tokens of texts, and where each text's begin (one entry more)."""
    buffer = b" ".join([*values, b""])
    kinds = _KIND[np.frombuffer(buffer, np.uint8)]
    starts = np.flatnonzero((kinds != np.concatenate(([0], kinds[:-1]))) & (kinds > 0))
    ends = np.flatnonzero((kinds != np.append(kinds[1:], 0)) & (kinds > 0)) + 1
    hashes = hashes_between(buffer, starts, ends)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter((len(v) + 1 for v in values), np.int64, len(values)))))
    return (hashes % np.uint64(SLOTS)).astype(np.int64), np.searchsorted(starts, offsets)


def _around(slots: np.ndarray, begins: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each token the sum of the index vectors around it, within its text."""
    apart = np.full(len(slots) + AROUND * (len(begins) + 1), SLOTS, np.int64)
    at = np.arange(len(slots)) + AROUND * (np.repeat(np.arange(len(begins) - 1), np.diff(begins)) + 1)
    apart[at] = slots
    out = np.zeros((len(slots), DIMENSIONS), np.float32)
    for step in range(1, AROUND + 1):
        out += index[apart[at - step]]
        out += index[apart[at + step]]
    return out


class Vectors(NamedTuple):
    """A vector for each slot."""

    vectors: np.ndarray

    def pool(self, values: list[bytes]) -> np.ndarray:
        """Mean, spread and mean step of the word vectors of each text; zero for a text without tokens."""
        slots, begins = slots_of(values)
        counts = np.diff(begins)
        full = np.flatnonzero(counts)
        out = np.zeros((len(values), FEATURES), np.float32)
        if len(full):
            own = self.vectors[slots]
            mean = np.add.reduceat(own, begins[full], axis=0) / counts[full, None]
            square = np.add.reduceat(own * own, begins[full], axis=0) / counts[full, None]
            step = np.zeros_like(own)
            np.subtract(own[1:], own[:-1], out=step[1:])
            step[begins[full]] = 0
            step = np.add.reduceat(np.abs(step, out=step), begins[full], axis=0) / np.maximum(1, counts[full, None] - 1)
            out[full] = np.concatenate([mean, np.sqrt(np.maximum(0, square - mean * mean)), step], axis=1)
        return out


def learn_vectors(docs: DataFrame) -> Vectors:
    """Word vectors from all texts of `docs`. Sums are of whole numbers: their order does not matter."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        sums, counts = np.zeros((DIMENSIONS, SLOTS)), np.zeros(SLOTS)
        for batch in batches:
            for part in slices(batch, "text", _STEP_BYTES):
                slots, begins = slots_of(texts(part.column("text")))
                around = _around(slots, begins, index)
                for d in range(DIMENSIONS):
                    sums[d] += np.bincount(slots, weights=around[:, d], minlength=SLOTS)
                counts += np.bincount(slots, minlength=SLOTS)
        seen = np.flatnonzero(counts)
        columns = [seen, counts[seen], *(row[seen] for row in sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    names = ["slot", "n", *(f"v{d}" for d in range(DIMENSIONS))]
    summed = (
        docs.select("text")
        .mapInArrow(step, ", ".join(f"{n} long" for n in names))
        .groupBy("slot")
        .agg(*[F.sum(n).alias(n) for n in names[1:]])
        .toArrow()
    )
    sums = np.zeros((SLOTS, DIMENSIONS + 1))
    if summed.num_rows:
        sums[summed.column("slot").to_numpy()] = np.stack([summed.column(n).to_numpy() for n in names[1:]], axis=1)
    count, total = sums[:, :1], sums[:, 1:]
    mean = total.sum(axis=0) / max(1.0, count.sum())
    vectors = (total - count * mean) / (count + PRIOR)
    return Vectors((vectors / max(1e-9, float(np.sqrt((vectors**2).mean())))).astype(np.float32))


def pooled(docs: DataFrame, vectors: Vectors, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs`, and `features` of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    narrow = docs.select(*keep, "text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in narrow.select(*keep).dtypes)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _STEP_BYTES):
                rows = shared.value.pool(texts(part.column("text")))
                offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, lists], [*keep, "features"])

    return narrow.mapInArrow(step, f"{kinds}, features array<float>")


class Network(NamedTuple):
    """Two layers over scaled features; `temperature` divides what they give."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probabilities that the label is 1, each row for itself."""
        # Not by a matrix product: its rounding depends on how many rows there are.
        hidden = np.tanh(np.einsum("nd,dh->nh", (features - self.centre) / self.scale, self.w1, optimize=False) + self.b1)
        return 1 / (1 + np.exp(-np.clip(((hidden * self.w2).sum(axis=1) + self.b2) / self.temperature, -50, 50)))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one of least log loss between 1/8 and 8."""
    if not len(labels):
        return 1.0
    tried = np.exp2(np.linspace(-3, 3, 121))
    signed = np.where(labels > 0, logits, -logits)
    return float(tried[np.argmin([np.logaddexp(0, -signed / t).mean() for t in tried])])


def fit(features: np.ndarray, labels: np.ndarray, seed: int = 8) -> Network:
    """Adam on the log loss with weight decay. Without both labels a constant network: their share, or a half."""
    size = features.shape[1]
    constant = Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0):
        return constant._replace(b2=3.0 if share else -3.0)
    if not len(labels):
        return constant
    apart = np.arange(len(labels)) % 5 == 0
    if len(set(labels[~apart])) < 2:
        apart[:] = False
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x, y = ((features - centre) / scale)[~apart], labels[~apart].astype(float)
    random = np.random.default_rng(seed)
    weights = [random.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for epoch in range(1, EPOCHS + 1):
        hidden = np.tanh(x @ weights[0] + weights[1])
        error = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3]))) - y) / len(y)
        back = error[:, None] * weights[2] * (1 - hidden * hidden)
        slopes = [x.T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], error.sum(keepdims=True)]
        for w, m, v, g in zip(weights, first, second, slopes, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    network = Network(centre, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    if apart.any():
        inner = np.clip(network.score(features[apart]), 1e-9, 1 - 1e-9)
        network = network._replace(temperature=_temperature(np.log(inner / (1 - inner)), labels[apart]))
    return network


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`.

    Word vectors are learned from all texts; the network from up to
    `most_rows` rows with a label and crc32 of the id not divisible by 5, in
    order of a hash. Of several labels of a document the lowest counts, other
    values than 0 and 1 do not. Null and empty texts are scored as texts
    without tokens. Without labels every score is a half.
    """
    known = written(
        pooled(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), learn_vectors(docs), ["doc_id", "held_out"]), "pooled"
    )
    truth = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = known.where("NOT held_out").join(truth, "doc_id")
    sample = sampled(labelled, most_rows, "doc_id", "features").select("features", "quality").toArrow()
    rows = np.array(sample.column("features").to_pylist(), np.float64).reshape(-1, FEATURES)
    network = fit(rows, np.array(sample.column("quality").to_pylist(), np.int64))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column("features").flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            score = network.score(features)
            new = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *new], ["doc_id", "held_out", "score", "predicted"])

    return known.mapInArrow(step, f"doc_id {kind}, held_out boolean, score double, predicted int")
