"""Fill-in-the-middle: documents cut at two ranks and put together with the middle last.

A text is a row of units, by default its code points. An indexable skip list
lies over them: its base lane has a node for each run of units, and every lane
above has some quarter of the towers of the one below. A link knows its width
twice, in units and in code points. Going down from the top lane, adding the
widths of the links taken, leads to the node that holds a rank, and tells at
which code point it is; what is left of the rank is found within the node.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tiffinlake.llm.common import slices, texts
from tiffinlake.llm.words import mixed

SEED = 1
#: Of 100 documents so many stay as they are, and of 100 others so many have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units in a node of the base lane.
NODE_UNITS = 64


@cache
def _lanes(size: int) -> tuple[np.ndarray, ...]:
    """Which of `size` boundaries have a tower in each lane, lowest lane first.

    A tower is as high as the hash of its place ends in pairs of zero bits;
    the first boundary is where every descent begins and has no limit.
    """
    hashes = mixed(np.arange(size, dtype=np.uint64) + np.uint64(1))
    lanes, lane = [], np.arange(size)
    while True:
        lanes.append(lane)
        if len(lane) <= 4:
            return tuple(lanes)
        shift = np.uint64(2 * (len(lanes) - 1))
        higher = (hashes[lane] >> shift) & np.uint64(3) == 0
        higher[0] = True
        lane = lane[higher]


class SkipList:
    """Ranks of units to ranks of code points.

    `lengths` are the code points of each unit, or the number of units if each
    is one code point.
    """

    def __init__(self, lengths: np.ndarray | int, node_units: int = NODE_UNITS):
        alike = isinstance(lengths, int)
        self.units = lengths if alike else len(lengths)
        self.lengths, self.node_units = None if alike else lengths, node_units
        nodes = -(-self.units // node_units)
        # Equal sizes, rounded up to a power of two, share the towers.
        towers = _lanes(1 << max(0, nodes).bit_length())
        at = np.minimum(np.arange(nodes + 1) * node_units, self.units)
        self.lanes = []
        for lane in towers:
            lane = lane[: int(np.searchsorted(lane, nodes))]
            ends = np.append(lane, nodes)
            unit_widths = np.diff(at[ends])
            if alike:
                point_widths = unit_widths
            else:
                running = np.concatenate(([0], np.cumsum(lengths)))
                point_widths = np.diff(running[at[ends]])
            self.lanes.append((lane, unit_widths, point_widths))

    def point(self, rank: int) -> int:
        """How many code points the first `rank` units have."""
        units = points = node = 0
        for lane, unit_widths, point_widths in reversed(self.lanes):
            link = int(np.searchsorted(lane, node))
            while link < len(lane) and units + unit_widths[link] <= rank:
                units += int(unit_widths[link])
                points += int(point_widths[link])
                link += 1
            if link == len(lane):
                break  # at the end
            node = lane[link]
        left = rank - units
        return points + (left if self.lengths is None else int(self.lengths[units : units + left].sum()))


def unit_lengths(text: str, unit: str | None) -> np.ndarray | int:
    """Code points of each unit of a text.

    A unit ends where a match of the pattern does, and the last one where the
    text does; what no match covers goes to the unit after it.
    """
    if unit is None:
        return len(text)
    ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends = [*ends[:-1], len(text)]
    return np.diff(np.array([0, *ends]))


def draws(id_column: str | Column = "doc_id", seed: int = SEED) -> Column:
    """32 hex digits for a row, by its id; null is drawn for as an empty id."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))), 256), 1, 32)


def arrange(text: str, digits: str, unit: str | None = None, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT):
    """(units, form, prefix, middle in code points, output) of one text; see `transform`."""
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    lengths = unit_lengths(text, unit)
    ranks = SkipList(lengths)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        return ranks.units, "plain", None, None, text
    first, second = sorted((h1 % (ranks.units + 1), h2 % (ranks.units + 1)))
    begin, end = ranks.point(first), ranks.point(second)
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if h4 % 100 < suffix_first_percent:
        return ranks.units, "spm", begin, end - begin, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return ranks.units, "psm", begin, end - begin, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: str, form: str) -> str:
    """The text again, from output and form alone; no part holds a mark, so the first of each is it."""
    if form == "plain":
        return output
    head, other = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(head).partition(other)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


# Bytes that are not UTF-8 are kept as they are.
def _decoded(value: bytes) -> str:
    return value.decode("utf-8", "surrogateescape")


def _encoded(value: str) -> bytes:
    return value.encode("utf-8", "surrogateescape")


def _mapped(docs: DataFrame, id_column: str, text_column: str, seed: int, step: Callable, names: list[str], schema: str) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), draws(id_column, seed).alias("digits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = map(_decoded, texts(part.column("text")))
                made = [step(text, digits) for text, digits in zip(values, part.column("digits").to_pylist(), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    out = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(schema).fields])
    return rows.mapInArrow(run, out)


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, **options) -> DataFrame:
    """doc_id, units, form, prefix_chars, middle_chars and output of each row of `docs`.

    The two cuts are drawn by the id, from 0 to the number of units each. A
    text that is null or empty, or holds a mark, stays plain, as do
    `plain_percent` of the others; its two lengths are null. `suffix_first_percent`
    of what is cut has the suffix first. `unit` is a pattern of units, code
    points without it. Rows that repeat are drawn alike; other columns, whatever
    their names, have no part; no row is lost.
    """
    names = ["units", "form", "prefix_chars", "middle_chars", "output"]

    def step(text: str, digits: str) -> tuple:
        return arrange(text, digits, **options)

    return _mapped(docs, id_column, text_column, seed, step, names, "units long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """Adds the text to what `transform` gave, from output and form; a null text has become an empty one."""
    forms = F.col("form")
    part = lambda group, pattern: F.regexp_extract("output", pattern, group)
    psm = f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$"
    spm = f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$"
    text = F.when(forms == "plain", F.col("output")).when(forms == "psm", F.concat(part(1, psm), part(3, psm), part(2, psm)))
    return made.withColumn("text", text.otherwise(F.concat(part(2, spm), part(3, spm), part(1, spm))))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: `transform`, and the text rebuilt from its output."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def step(text: str, digits: str) -> tuple:
        _, form, prefix, middle, output = arrange(text, digits, **options)
        hexes = (hashlib.sha256(_encoded(t)).hexdigest() for t in (output, restored(output, form)))
        return len(text), form, prefix, middle, *hexes

    return _mapped(docs, id_column, text_column, seed, step, names, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
