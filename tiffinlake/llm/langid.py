"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams, by rank. A
document's own most frequent n-grams are compared to each profile by the sum of
the distances between ranks, an n-gram that the profile lacks counting as far
as the profile is long; the nearest language wins. An n-gram of up to three
letters is a number, 21 bits a letter, so that counting is sorting numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiffinlake.llm.common import boxed, slices, with_fields

#: N-grams in a profile, and lengths of n-grams; both as parameters.
PROFILE = 400
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: A text nearer than this to no language, as its score tells, is in none of them.
LEAST_SCORE = 0.2
_SPACE = ord("_")


def held_out(modulus: int, remainder: int, id_column: str = "doc_id"):
    """Whether a row is kept out of learning: crc32 of its id as text. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus == remainder, F.lit(False))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(text: str) -> np.ndarray:
    """Code points in lower case; each run of other characters, and either end, as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, _SPACE).astype(np.uint64)
    codes = np.concatenate(([_SPACE], codes, [_SPACE])).astype(np.uint64)
    space = codes == _SPACE
    return codes[~space | ~np.concatenate(([False], space[:-1]))]


def grams_of(codes: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    """All n-grams as numbers; single spaces are none."""
    out = []
    for n in orders:
        if len(codes) >= n:
            gram = codes[: len(codes) - n + 1].copy()
            for k in range(1, n):
                gram = (gram << np.uint64(21)) | codes[k : len(codes) - n + 1 + k]
            out.append(gram[gram != _SPACE])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def ranked(grams: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:most]]


def profiles(docs: DataFrame, orders: tuple[int, ...] = ORDERS, most: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0): the most frequent n-grams of all texts in `docs` with a language.

    Counted in each task before they are summed; a language is cut to its top
    in 16 parts first, so that no task sorts all n-grams of the largest one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(letters_of(text))
                for lang, codes in by_lang.items():
                    values, counts = np.unique(np.concatenate([grams_of(c, orders) for c in codes]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts)],
                        ["lang", "gram", "n"],
                    )

    counted = (
        docs.select("lang", "text")
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(16)))
    )
    for within in (["lang", "part"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*within).orderBy(F.col("n").desc(), "gram"))
        counted = counted.withColumn("nth", nth).where(F.col("nth") <= most)
    return counted.select("lang", "gram", (F.col("nth") - 1).alias("rank"))


class Model:
    """The profiles as arrays: `most` numbers and ranks for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], orders: tuple[int, ...] = ORDERS, most: int = PROFILE):
        self.orders, self.most = orders, most
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.uint64))
        # One more column than there are n-grams: what no profile holds.
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), most, np.int64)
        place = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[place[lang], np.searchsorted(self.grams, np.uint64(gram))] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and how near it is: 1 for the profile itself, 0 if it shares no n-gram.

        `und` with 0 for a null text, one without letters, or an empty model.
        """
        codes = letters_of(text or "")
        if not self.langs or not (codes != _SPACE).any():
            return UNKNOWN, 0.0
        own = ranked(grams_of(codes, self.orders), self.most)
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        ranks = self.ranks[:, np.where(known, at, len(self.grams))]
        far = np.where(ranks == self.most, self.most, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.most * len(own)))


def fit(docs: DataFrame, orders: tuple[int, ...] = ORDERS, most: int = PROFILE) -> Model:
    """Learn from all rows of `docs` with text and lang. The driver gets `most` rows a language."""
    return Model([tuple(row) for row in profiles(docs, orders, most).collect()], orders, most)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1) from the whole text alone; other columns pass.

    Columns of these names are replaced. No row is lost; an empty table gives
    an empty one.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    narrow = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(text) for text in batch.column("text").to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "lang_pred", "score"])

    return narrow.mapInArrow(step, with_fields(narrow, "lang_pred string, score double"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all of `docs`, learned from the rows that are not held out."""
    marked = docs.select("doc_id", "text", "lang", held_out(3, 1).alias("held_out"))
    model = fit(marked.where("NOT held_out"))
    return predict(marked.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def reject_unknown(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """`docs` without texts in no language: no letters, or nearer than `least` to none."""
    model = fit(docs.where(~held_out(3, 1)))
    found = predict(boxed(docs, "text"), model)
    return found.where(F.col("score") >= least).select("_row.*")
