"""Benchmark decontamination: a BM25 index of test items that every training passage queries by block-max WAND.

An item's terms weigh what BM25 gives them, as shares of the item's own total,
so that a passage with all its terms scores 1 and one threshold fits all items.
The postings of a term are cut into blocks of items, each with the largest
weight in it. The light terms of a passage, which together stay below the
threshold, open no block; blocks with a heavy one add up the maxima of all
terms, for all passages of a batch at once, and those that cannot reach the
threshold are never opened. In the others, pivoting over the postings scores
the items that can. What comes out is verified on the words themselves,
question and answer each.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffinlake.llm.common import boxed, row_key, slices, with_fields, written

#: Share of an item's BM25 weight that a passage must hold.
THRESHOLD = 0.6
#: Share of the words of the question, and of the answer, that must be found, in alignments of 5 equal words net of edits.
OVERLAP = 0.8
RUN = 5
BLOCK_ITEMS = 4
K1, B = 1.2, 0.75
#: Words of items in one index, which goes to every executor; more items take more passes over the documents.
INDEX_WORDS = 1_000_000
_WORD = r"[\p{L}\p{N}_]+"
_FIND = re.compile(r"\w+").findall
_ANSWER = re.compile(r"(?<=[.!?\n])\s+(?=\S)")


def words_of(text: str | None) -> list[str]:
    return _FIND((text or "").lower())


def question_words(text: str) -> int:
    """How many words are the question: all but the last sentence, or two thirds of a single one."""
    count = len(words_of(text))
    last = len(words_of(_ANSWER.split(text.strip())[-1]))
    return count - last if 0 < last < count else max(1, count * 2 // 3)


class Item(NamedTuple):
    item_id: object
    words: list[str]
    question: int


class Index:
    """Postings of a part of the items, with block maxima.

    `frequent` says in how many of all `total` items each term is, so that
    parts score alike.
    """

    def __init__(self, items: list[Item], frequent: dict[str, int], total: int, mean_words: float):
        self.items = items
        weighed: dict[str, list[tuple[int, float]]] = {}
        for place, item in enumerate(items):
            counts: dict[str, int] = {}
            for word in item.words:
                counts[word] = counts.get(word, 0) + 1
            weights = {}
            for term, n in counts.items():
                idf = np.log1p((total - frequent[term] + 0.5) / (frequent[term] + 0.5))
                weights[term] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(item.words) / mean_words))
            whole = sum(weights.values())
            for term, weight in weights.items():
                weighed.setdefault(term, []).append((place, weight / whole))
        # Light terms have low numbers.
        terms = sorted(weighed, key=lambda t: (max(w for _, w in weighed[t]), t))
        self.ids = {t: i for i, t in enumerate(terms)}
        rows = [(i, place, weight) for i, t in enumerate(terms) for place, weight in weighed[t]]
        self.term = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows])
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        # Block maxima, by term and block, and where the block's postings begin.
        block = self.item // BLOCK_ITEMS
        fresh = (np.diff(self.term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)
        self.heads = np.append(np.flatnonzero(fresh), len(self.term))
        self.block = block[fresh]
        self.key = self.term[fresh] * self.blocks + self.block
        self.block_max = np.maximum.reduceat(self.weight, self.heads[:-1])
        self.block_begins = np.searchsorted(self.term[fresh], np.arange(len(terms) + 1))
        self.term_max = np.maximum.reduceat(self.block_max, self.block_begins[:-1])

    def _find(self, term: np.ndarray, block: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of term and block whether there are postings, and the place of their maximum."""
        key = term * self.blocks + block
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, at

    def open_blocks(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The (passage, block) whose block maxima add up to the threshold, from distinct (passage, term) in order."""
        threshold -= 1e-9
        found = [], []
        # So many passages at a time that their sums by block are a small matrix.
        most = max(1, (1 << 20) // self.blocks)
        ends = np.searchsorted(passage, np.arange(passage[0], passage[-1] + 1 + most, most))
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if lo < hi:
                first = passage[lo]
                p, block = self._open(passage[lo:hi] - first, term[lo:hi], threshold)
                found[0].append(p + first)
                found[1].append(block)
        return np.concatenate(found[0]), np.concatenate(found[1])

    def _open(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        count = int(passage[-1]) + 1
        running = np.concatenate(([0.0], np.cumsum(self.term_max[term])))
        begins = np.searchsorted(passage, np.arange(count + 1))
        heavy = running[1:] - running[begins[passage]] >= threshold
        light_ends = begins[:-1] + np.bincount(passage[~heavy], minlength=count)
        light = running[light_ends] - running[begins[:-1]]
        own, at = _expanded(self.block_begins, term[heavy])
        sums = np.bincount(passage[heavy][own] * self.blocks + self.block[at], weights=self.block_max[at], minlength=count * self.blocks)
        keys = np.flatnonzero(sums.reshape(count, -1) >= np.where(light < threshold, threshold - light, threshold)[:, None])
        sums = sums[keys]
        # What the light terms really have in these blocks.
        lo, lights = begins[keys // self.blocks], (light_ends - begins[:-1])[keys // self.blocks]
        own = np.repeat(np.arange(len(keys)), lights)
        at = np.arange(lights.sum()) + np.repeat(lo - np.cumsum(lights) + lights, lights)
        there, at = self._find(term[at], (keys % self.blocks)[own])
        sums += np.bincount(own[there], weights=self.block_max[at[there]], minlength=len(keys))
        keys = keys[sums >= threshold]
        return keys // self.blocks, keys % self.blocks

    def search_block(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """WAND within a block: (item, score) of at least the threshold.

        Terms stand in order of their next item. The pivot is the first term at
        which the block maxima passed so far reach the threshold: no item
        before the pivot's can, so the terms skip to it; once all terms up to
        the pivot stand on its item, it is scored.
        """
        there, at = self._find(terms, block)
        at = at[there]
        lists = [
            [0, self.item[lo:hi].tolist(), self.weight[lo:hi].tolist(), most]
            for lo, hi, most in zip(self.heads[at], self.heads[at + 1], self.block_max[at].tolist(), strict=True)
        ]
        found = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= threshold - 1e-9:
                    pivot = x[1][x[0]]
                    break
            if pivot is None:
                break
            if lists[0][1][lists[0][0]] == pivot:
                score = 0.0
                for x in lists:
                    if x[1][x[0]] != pivot:
                        break
                    score += x[2][x[0]]
                    x[0] += 1
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
            else:
                for x in lists:
                    while x[0] < len(x[1]) and x[1][x[0]] < pivot:
                        x[0] += 1
            lists = [x for x in lists if x[0] < len(x[1])]
        return found


def _expanded(begins: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the lists `of`, that begin at `begins`, and which list each is from."""
    counts = begins[of + 1] - begins[of]
    own = np.repeat(np.arange(len(of)), counts)
    return own, np.arange(counts.sum()) + np.repeat(begins[of] - np.cumsum(counts) + counts, counts)


def covered(item: Item, passage: list[str], run: int = RUN, overlap: float = OVERLAP) -> tuple[float, float]:
    """Shares of the words of question and answer that are found in the passage.

    A word is found if it lies in an alignment of item and passage that has
    `run` more equal words than edits: a word replaced, left out or put in.
    As many edits as `overlap` leaves an item so cost no other word than their
    own, wherever they are. A part of fewer than `run` words is measured with
    its neighbours, as no single word decides on a part. Of items so short that
    those edits leave less than `run`, what is left is asked for. Shares below
    `overlap` may be of runs of equal words alone.
    """
    count = len(item.words)
    edits = _edits(count, overlap)
    run = min(run, count)
    there = {tuple(passage[i : i + run]) for i in range(len(passage) - run + 1)}
    hit = np.zeros(count, bool)
    for i in range(count - run + 1):
        if tuple(item.words[i : i + run]) in there:
            hit[i : i + run] = True
    part = min(RUN, count)
    question, answer = slice(max(item.question, part)), slice(min(item.question, count - part), count)
    if not hit.all():
        own = set(passage)
        known = np.array([w in own for w in item.words])
        # No alignment has words that the passage has not.
        if min(known[question].mean(), known[answer].mean()) >= overlap:
            need = max(1, min(run, count - 2 * edits))
            hit |= _aligned(item.words, passage, need, run + edits)
    return float(hit[question].mean()), float(hit[answer].mean())


def _edits(words: int, overlap: float) -> int:
    """How many of the words may be missing."""
    return int(words * (1 - overlap) + 1e-9)


def _aligned(words: list[str], passage: list[str], need: int, most: int) -> np.ndarray:
    """Which words are equal in a local alignment of a score of `need`: 1 for an equal word, -1 for an edit.

    Up to a word and from it on a score counts as `most` at the utmost, so that
    a long question does not pay for words far behind it.
    """
    places: dict[str, list[int]] = {w: [] for w in words}
    for j, word in enumerate(passage):
        if word in places:
            places[word].append(j)
    equal = [np.array(places[w], np.int64) for w in words]
    ahead = _scores(equal, len(passage), most)
    back = _scores([len(passage) - 1 - e[::-1] for e in reversed(equal)], len(passage), most)[::-1]
    return np.array([bool(len(f)) and int((f + b[::-1]).max()) > need for f, b in zip(ahead, back, strict=True)])


def _scores(equal: list[np.ndarray], length: int, most: int) -> list[np.ndarray]:
    """Best scores of alignments that end at each word's equal places in the passage."""
    slope = np.arange(length + 1, dtype=np.int32)
    row, out = np.zeros(length + 1, np.int32), []
    for at in equal:
        new = row - 1
        np.maximum(new[1:], row[:-1] - 1, out=new[1:])
        new[at + 1] = np.minimum(row[at] + 1, most)
        out.append(new[at + 1])
        new = np.maximum.accumulate(new + slope) - slope
        row = np.maximum(new, 0)
    return out


def find(index: Index, documents: list[str | None], threshold: float, overlap: float) -> list[tuple]:
    """(document, item, score, question_overlap, answer_overlap, first_word) of what is verified, best passage each.

    Passages overlap by the longest item and the words that may be put in it, so
    that one holds any whole item.
    """
    longest = max(len(item.words) for item in index.items)
    step = max(64, longest + _edits(longest, overlap))
    passage, term, words, firsts = [], [], [], [0]
    get = index.ids.get
    for text in documents:
        own = words_of(text)
        words.append(own)
        ids = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
        places = np.flatnonzero(ids >= 0)
        # A passage is two steps long; a word is in the one its step begins and in the one before.
        at = firsts[-1] + 1 + places // step
        passage += [at, at - 1]
        term += [ids[places]] * 2
        firsts.append(firsts[-1] + 2 + len(own) // step)
    passages, terms = np.concatenate(passage), np.concatenate(term)
    if not len(terms):
        return []
    pairs = np.unique(passages * len(index.ids) + terms)
    passages, terms = pairs // len(index.ids), pairs % len(index.ids)
    begins = np.searchsorted(passages, np.arange(firsts[-1] + 1))
    best: dict[tuple[int, int], tuple] = {}
    for p, block in zip(*index.open_blocks(passages, terms, threshold), strict=True):
        for place, score in index.search_block(terms[begins[p] : begins[p + 1]], int(block), threshold):
            document = int(np.searchsorted(firsts, p, "right")) - 1
            start = max(0, (int(p) - firsts[document] - 1) * step)
            item = index.items[place]
            question, answer = covered(item, words[document][start : start + 2 * step], overlap=overlap)
            found = (document, item.item_id, min(1.0, score), question, answer, start)
            if question >= overlap and answer >= overlap and found[2:5] > best.get((document, place), (0,) * 6)[2:5]:
                best[document, place] = found
    return list(best.values())


def _known(items: DataFrame) -> DataFrame:
    return items.select("item_id", "text").where(F.col("text").rlike(_WORD)).distinct()


def parts_of(items: DataFrame, index_words: int = INDEX_WORDS) -> tuple[int, int, float]:
    """How many indexes the items take, how many items there are, and their mean number of words."""
    words = _known(items).select(F.regexp_count("text", F.lit(_WORD)).alias("n"))
    total, count = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return (-(-total // index_words), count, total / count) if count else (0, 0, 0.0)


def indexes(items: DataFrame, index_words: int = INDEX_WORDS) -> Iterator[Index]:
    """Indexes over parts of the items of up to some `index_words` words each. Statistics are of all items.

    Null texts and texts without words are no items. Items equal in id and text
    are one. Each part is built in a task, and the next one when it is asked
    for, so that the driver holds no more than one.
    """
    known = _known(items)
    parts, count, mean = parts_of(items, index_words)
    terms = known.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))

    def build(mine: pa.Table, frequencies: pa.Table) -> pa.Table:
        # Equal words are one object, also in the executors.
        once: dict[str, str] = {}
        rows = sorted(zip(mine["item_id"].to_pylist(), mine["text"].to_pylist(), strict=True), key=lambda r: (str(r[0]), r[1]))
        found = [Item(i, [once.setdefault(w, w) for w in words], question_words(t)) for i, t in rows if (words := words_of(t))]
        frequent = dict(zip(frequencies["term"].to_pylist(), frequencies["n"].to_pylist(), strict=True))
        for word in {w for item in found for w in item.words}:
            frequent.setdefault(word, 1)
        blobs = [pickle.dumps(Index(found, frequent, count, mean))] if found else []
        return pa.table({"built": pa.array(blobs, pa.binary())})

    for part in range(parts):
        mine = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).withColumn("part", F.lit(part))
        own = mine.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).distinct()
        frequent = terms.join(own, "term", "left_semi").withColumn("part", F.lit(part))
        for row in mine.groupBy("part").cogroup(frequent.groupBy("part")).applyInArrow(build, "built binary").collect():
            yield pickle.loads(row.built)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def matches(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_words: int = INDEX_WORDS
) -> DataFrame:
    """A row for each document and test item it holds: doc_id, item_id, score, question_overlap, answer_overlap, first_word.

    Words are runs of letters, digits and `_` in lower case. Every text is
    searched as a whole, in passages. A document without a match has no row,
    nor have null and empty texts; no items, no rows. Rows of `docs` that
    repeat have rows each. `first_word` is where the best passage begins.
    """
    return _search(docs.select("doc_id", "text"), ["doc_id"], items, threshold, overlap, index_words)


def _search(docs: DataFrame, keep: list[str], items: DataFrame, threshold: float, overlap: float, index_words: int) -> DataFrame:
    """Matches with the columns `keep`. With more than one index each pass is written and its broadcast released."""
    spark = docs.sparkSession
    fields = "score double, question_overlap double, answer_overlap double, first_word long"
    schema = with_fields(docs.select(*keep), f"item_id {items.schema['item_id'].dataType.simpleString()}, {fields}")
    found = spark.createDataFrame([], schema)
    parts, _, _ = parts_of(items, index_words)
    for index in indexes(items, index_words):
        shared = spark.sparkContext.broadcast(index)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    rows = find(shared.value, part.column("text").to_pylist(), threshold, overlap)
                    if rows:
                        columns = list(zip(*rows, strict=True))
                        head = part.select(keep).take(pa.array(columns[0], pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [*head.columns, *map(pa.array, columns[1:])], [f.name for f in schema.fields]
                        )

        own = docs.mapInArrow(step, schema)
        if parts > 1:
            own = written(own, "item-matches")
            shared.unpersist(blocking=True)
        found = found.unionByName(own)
    return found


def remove_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_words: int = INDEX_WORDS
) -> DataFrame:
    """`docs` without the rows that hold a test item; all columns, other rows untouched.

    A single index filters the rows as they are read. Of several, each notes the
    keys of the rows it finds, and these go at the end.
    """
    parts, _, _ = parts_of(items, index_words)
    if parts > 1:
        keyed = boxed(docs, "text", *row_key("doc_id", "text"))
        found = _search(keyed.select("_k1", "_k2", "text"), ["_k1", "_k2"], items, threshold, overlap, index_words)
        return keyed.join(found.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_anti").select("_row.*")
    for index in indexes(items, index_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    rows = find(shared.value, part.column("text").to_pylist(), threshold, overlap)
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in rows]] = False
                    yield part.select(["_row"]).filter(pa.array(clean))

        narrow = boxed(docs, "text")
        docs = narrow.mapInArrow(step, narrow.select("_row").schema).select("_row.*")
    return docs
