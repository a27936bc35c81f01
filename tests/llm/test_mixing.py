import math
from collections import defaultdict

import pytest
from odd import empty, odd

from tiffinlake.llm import mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by the words of the rule: share, stop at the caps, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = {s: weight[s] for s in names if s not in fixed}
        rest = total - sum(fixed.values())
        target = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if target[s] > most * sizes[s]]
        if not over:
            return target | fixed
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, block=mixing.BLOCK_WORDS):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    targets = filled({s: sum(r.size for r in own) for s, own in by_source.items()})
    for source, own in by_source.items():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert all(math.isclose(r.target, targets[source], rel_tol=1e-9, abs_tol=1e-9) for r in own)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - targets[source]) <= 2 * block + 0.01 * targets[source]


def test_targets_and_words_taken(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    check(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def test_many_shards_and_a_hot_source(spark):
    rows = [(i, "w " * (i % 17), "hot" if i % 3 else f"s{i % 8}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, block_words=1, shard_docs=50).collect()
    check(found, block=30)


@pytest.mark.parametrize("claims, seats, most", [([53, 24, 23], 7, 100), ([100, 1, 1, 1], 10, 100), ([5, 5, 5], 4, 100), ([90, 10], 10, 3), ([0, 0], 0, 0), ([1e6, 3, 2, 1], 999, 10**6)])
def test_seats_go_by_highest_quotients(spark, claims, seats, most):
    parties = spark.createDataFrame(
        [("g", i, float(c), seats, most) for i, c in enumerate(claims)], "g string, party long, claim double, seats long, most long"
    )
    got = {r.party: r.quota for r in mixing.sainte_lague(parties, ["g"], "party", "claim", "seats", "most").collect()}
    expected = dict.fromkeys(range(len(claims)), 0)
    for _ in range(seats):
        open_ = [i for i in expected if expected[i] < most and claims[i] > 0]
        if not open_:
            break
        winner = max(open_, key=lambda i: (claims[i] / (2 * expected[i] + 1), -i))
        expected[winner] += 1
    if most >= seats:
        assert got == expected
    assert all(q <= most for q in got.values())


def test_odd_rows(spark):
    found = mixing.mix(odd(spark)).collect()
    assert len(found) == odd(spark).count()
    assert all(r.size == 0 and r.taken == 0 for r in found if r.doc_id in (3, 4, 9))
    check(found)
    assert mixing.mix(empty(spark)).collect() == []
    nothing = mixing.mix(odd(spark).where("doc_id in (3, 4)")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
