import hashlib
from collections import defaultdict
from fractions import Fraction
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from tiffinlake.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, _of int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], SCHEMA)


def expected(rows, parts=16, entries=64, rounds=2):
    """In plain Python integers, entry by entry."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    if not rows:
        return []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    length = len(order[0][1])
    width = length // parts
    whole = [[floor(Fraction(x) * 256) for x in v] for _, v, _ in rows]
    books = [[[floor(Fraction(x) * 256) for x in v[p * width : (p + 1) * width]] for _, v, _ in order if len(v) == length] for p in range(parts)]

    def nearest(part, cut):
        return min((sum((a - b) ** 2 for a, b in zip(cut, e)), k) for k, e in enumerate(books[part]))

    for _ in range(rounds):
        members = defaultdict(list)
        for v in whole:
            if len(v) == length:
                for p in range(parts):
                    cut = v[p * width : (p + 1) * width]
                    members[p, nearest(p, cut)[1]].append(cut)
        for (p, k), cuts in members.items():
            books[p][k] = [sum(c) // len(cuts) for c in zip(*cuts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], defaultdict(list)
    for (i, _, label), v in zip(rows, whole):
        near = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)] if len(v) == length else None
        error = sum(n[0] for n in near) if near else None
        error = None if error is None or error >= 1 << 63 else error
        out.append((i, label, "".join(f"{n[1]:02x}" for n in near) if near else None, error))
        if error is not None:
            sums[label].append(error)
    total = {label: sum(e) if sum(e) < 1 << 63 else None for label, e in sums.items()}
    return [(i, code, error, total.get(label), sha) for i, label, code, error in out]


def check(spark, rows, **options):
    found = vc.compress(frame(spark, rows), **options)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows, **options), key=str)


def random_rows(count, length, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(size=length) * scale).tolist(), int(i) % 3) for i in range(count)]


@pytest.mark.parametrize("length", [16, 48, 80])
def test_random_vectors(spark, length):
    check(spark, random_rows(150, length))


def test_given_vectors(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted(map(tuple, vc.compress(table).collect()), key=str) == sorted(expected(rows), key=str)


def test_odd_rows(spark):
    rows = random_rows(100, 32)
    rows += [(i, v, None) for i, v, _ in rows[:7]] + [rows[3]] * 3
    rows += [(200, None, 1), (201, [None] * 32, 1), (202, [nan] * 32, 1), (203, [inf] * 32, 1), (None, [0.5] * 32, None)]
    rows += [(204, [0.0] * 32, 5), (205, [-0.0] * 32, 5), (206, [0.25] * 16, 6), (207, [], 6)]
    check(spark, rows)
    check(spark, rows[:5])
    check(spark, [(1, None, 1)])
    check(spark, [])
    check(spark, [(1, [], 1), (2, [], None)])


def test_a_length_that_parts_do_not_divide(spark):
    with pytest.raises(ValueError, match="17 components"):
        vc.compress(frame(spark, random_rows(3, 17)))


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e30, 1e300])
def test_large_components_are_exact(spark, scale):
    """Beyond 64 bits the codes are still right, and errors that do not fit are null."""
    rows = [*random_rows(60, 16), *((i + 60, v, label) for i, v, label in random_rows(60, 16, seed=2, scale=scale))]
    check(spark, rows, entries=20)


def test_hot_labels_and_many_partitions(spark):
    rows = [(i, [float(i % 7)] * 16, 1 if i % 3 else None) for i in range(2000)]
    found = vc.compress(frame(spark, rows).repartition(40))
    assert sorted(map(tuple, found.collect())) == sorted(expected(rows))


@pytest.mark.parametrize("size", [1, 2, 4, 8, 32])
def test_the_transform_keeps_distances_and_sorts_by_sequency(size):
    matrix = vc.walsh(np.eye(size, dtype=np.int64))
    assert (matrix.T @ matrix == size * np.eye(size)).all()
    changes = [int((np.diff(row) != 0).sum()) for row in matrix.T]
    assert changes == list(range(size))
    rng = np.random.default_rng(size)
    x, y = rng.integers(-999, 999, (2, 50, size))
    assert (((vc.walsh(x) - vc.walsh(y)) ** 2).sum(axis=1) == size * ((x - y) ** 2).sum(axis=1)).all()


@pytest.mark.parametrize("width", [1, 3, 4, 6, 16, 40])
def test_elimination_finds_the_first_of_the_nearest(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-3, 4, (64, width))
    entries[40:] = entries[:24]
    cuts = np.concatenate([rng.integers(-3, 4, (500, width)), entries])
    index, far = vc.nearest(vc.walsh(cuts), vc.walsh(entries))
    plain = ((cuts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (index == plain.argmin(axis=1)).all()
    size = vc.walsh(entries).shape[1]
    assert (far == size * plain.min(axis=1)).all()


def test_decoding_is_nearer_with_rounds(spark):
    kept = vc.usable(frame(spark, random_rows(400, 32)))
    vectors = np.array([r.vector for r in kept.orderBy("vec_id").collect()])
    lost = []
    for rounds in (0, 2, 6):
        books = vc.train(kept, rounds=rounds)
        codes = [list(bytes.fromhex(r.code)) for r in vc.encode(kept, books).orderBy("vec_id").collect()]
        lost.append(((books.decode(np.array(codes)) - vectors) ** 2).sum())
    assert lost[0] > lost[1] > lost[2]


def test_integers_are_floors():
    values = np.array([0.0, -0.0, 1 / 256, -1 / 512, 0.9999, -3.0001, 2.0**60, -(2.0**70), 2.0**45 + 0.5])
    assert [int(x) for x in vc.integers(values)] == [floor(Fraction(v) * 256) for v in values]
