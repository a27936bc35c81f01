import hashlib
import random

import numpy as np
import pytest
from odd import documents, empty, odd

from tiffinlake.llm import fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    """By slicing, as the contract has it."""
    text, n = text or "", len(text or "")
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        form, output = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, output = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, form, a, b - a, sha(output), sha(text)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_documents(spark, small):
    docs, rows = documents(spark, small)
    found = result(fim.digests(docs))
    assert found == sorted((expected(*row) for row in rows), key=str)
    assert {row[2] for row in found} == {"plain", "psm", "spm"}


MARKED = [
    (30, "a <P> b", None, None),
    (31, "<M>", None, None),
    (32, "<" * 300 + "S" + ">" * 300, None, None),
    (33, "P>x<" * 50, None, None),
    (34, "\U0001f600é日a" * 1000, None, None),
    (35, "x", None, None),
    (36, "x" * 64, None, None),
    (37, "x" * 65, None, None),
]


def test_odd_rows(spark):
    from odd import TEXTS

    docs = odd(spark, [*TEXTS, *MARKED])
    assert result(fim.digests(docs)) == sorted((expected(i, t) for i, t, *_ in [*TEXTS, *MARKED]), key=str)
    assert fim.digests(empty(spark)).collect() == []
    assert fim.digests(empty(spark)).columns == fim.digests(docs).columns


@pytest.mark.parametrize("unit", [None, r"\S+\s*", r"\w", r"[0-9]"])
def test_round_trip_for_any_unit(spark, unit):
    docs = odd(spark, [*[(i, "ab cd  é1 " * (i % 40), None, None) for i in range(200)], *MARKED])
    made = fim.transform(docs, unit=unit, plain_percent=0, suffix_first_percent=50)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    back = {(r.doc_id, r.text) for r in fim.restore(made).collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 20_000])
def test_descents_reach_every_rank(size):
    rng = np.random.default_rng(size)
    lengths = rng.integers(1, 9, size)
    running = np.concatenate(([0], np.cumsum(lengths)))
    mixed, alike = fim.SkipList(lengths), fim.SkipList(size)
    ranks = range(size + 1) if size <= 1000 else random.Random(1).sample(range(size + 1), 500)
    assert [mixed.point(r) for r in ranks] == [running[r] for r in ranks]
    assert [alike.point(r) for r in ranks] == list(ranks)


def test_lanes_thin_out_and_a_descent_is_short():
    ranks = fim.SkipList(1 << 20)
    sizes = [len(lane) for lane, *_ in ranks.lanes]
    assert len(sizes) > 4 and all(2 * b < a for a, b in zip(sizes, sizes[1:]))
    assert sizes[-1] <= 4
    assert all(units.sum() == points.sum() == 1 << 20 for _, units, points in ranks.lanes)


def test_units_cover_the_text():
    assert list(fim.unit_lengths("ab cd e", r"\S+\s*")) == [3, 3, 1]
    assert list(fim.unit_lengths("  ab .", r"\w+")) == [6]
    assert list(fim.unit_lengths("ab", r"[0-9]")) == [2]
    assert list(fim.unit_lengths("", r"\w")) == []
