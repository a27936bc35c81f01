import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from odd import PROSE, empty, odd

from tiffinlake.llm import ngramjoin
from tiffinlake.llm.graph import components


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def brute_force(rows):
    """(id, text) -> list of (id, class, links), by comparing all pairs that share an n-gram."""
    sets = [shingles(text) for _, text in rows]
    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for gram in own:
            holders[gram].append(i)
    shared = defaultdict(int)
    for members in holders.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                shared[members[a], members[b]] += 1
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n * 5 >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, links[i]) for i in members]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_equals_brute_force_on_the_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_force(rows)
    assert any(n for _, _, n in expected)
    assert result(ngramjoin.near_duplicates(docs)) == expected


@pytest.mark.parametrize("cell", [768, 20])
def test_a_large_group_of_near_copies_keeps_every_link(spark, cell):
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base) + [f"tail{k}" for k in range(int(random.integers(0, 60)))]
        for place in random.integers(0, len(words), int(random.integers(0, 4))):
            words[place] = f"x{random.integers(0, 5)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngramjoin.near_duplicates(docs, cell=cell)) == brute_force(rows)


def test_odd_rows(spark):
    docs = odd(spark)
    expected = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert result(ngramjoin.near_duplicates(docs)) == expected
    kept = ngramjoin.keep_one(docs)
    assert kept.schema == docs.schema
    ids = sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text and len(r.text) < 200)
    assert [i for i, t in ids if t == PROSE] in ([], [1])
    assert {3, 4, 5, 6, 7, 8, 9, 10} <= {r.doc_id for r in kept.collect()}
    assert ngramjoin.near_duplicates(empty(spark)).collect() == []
    assert ngramjoin.keep_one(empty(spark)).collect() == []


def test_one_of_a_group_stays(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    classes = {c for _, c, _ in brute_force([(r.doc_id, r.text) for r in docs.collect()])}
    assert sorted(r.doc_id for r in ngramjoin.keep_one(docs).select("doc_id").collect()) == sorted(classes)


def test_bands():
    bands, rows = ngramjoin.bands_and_rows(0.8, 0.9999, 192)
    assert bands * rows <= 192 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    assert ngramjoin.bands_and_rows(1.0) == (1, 1)
    with pytest.raises(ValueError):
        ngramjoin.bands_and_rows(0.1, 0.9999, 20)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 150)]
    star = [(7, 1000 + i) for i in range(40)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {i: 100 for i in range(100, 151)} | {7: 7} | {1000 + i: 7 for i in range(40)}
    assert components(edges.limit(0)).collect() == []


def test_classes_depend_on_members_only():
    a, b = np.array([3, 5, 9], np.uint64), np.array([3, 5], np.uint64)
    none = np.empty(0, np.uint64)
    names = ngramjoin.class_of([a, none, b, a, none])
    assert (names[0] == names[3]).all() and (names[0] != names[2]).all()
    assert not names[[1, 4]].any() and not ngramjoin.class_of([none]).any()


def test_links_by_matrix_equal_those_by_pairs():
    random = np.random.default_rng(1)
    pool = random.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(random.choice(pool[: int(random.integers(3, 60))], 40)) for _ in range(60)]
    links = ngramjoin.linked(sets, Fraction(1, 2))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert links[i, j] == (i != j and both * 2 >= len(a) + len(b) - both)


def test_candidates_are_what_buckets_connect(spark):
    """Chains, a large group of many overlapping buckets, lone classes: the components of the graph with all edges."""
    rng = np.random.default_rng(4)
    rows = [(i, [int(b) for b in rng.integers(0, 40, 6)]) for i in range(300)]
    rows += [(1000 + i, [10_000 + i, 10_001 + i]) for i in range(60)]
    rows += [(2000 + i, [20_000 + i]) for i in range(20)]
    rows += [(-5 - i, [30_000 + i % 3, 40_000 + i]) for i in range(30)]
    known = spark.createDataFrame(rows, "c1 long, buckets array<long>")
    found = {r.c1: r.component for r in ngramjoin.candidates(known).collect()}
    holders = defaultdict(list)
    for c, buckets in rows:
        for b in set(buckets):
            holders[b].append(c)
    stars = [(c, min(members)) for members in holders.values() for c in members if c != min(members)]
    plain = components(spark.createDataFrame(stars, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in plain:
        groups[r.component].add(r.node)
    mine = defaultdict(set)
    for c, component in found.items():
        mine[component].add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
    assert not any(c in found for c in range(2000, 2020))
    assert ngramjoin.candidates(known.where("c1 between 2000 and 2019")).collect() == []
