import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import documents, empty, odd
from pyspark.sql import functions as F

from tiffinlake.llm import brown
from tiffinlake.llm.words import word_hashes

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base(rows):
    """The exact part: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    counts = Counter()
    for i, t in rows:
        if not is_held_out(i):
            counts.update(words_of(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words_of(t), None]
        score = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, is_held_out(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, score))
    return out


def key(row):
    return tuple(map(str, row[:4])), row[5]


def check_base(found, rows):
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    expected = sorted(base(rows), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in expected], rel=1e-12, abs=1e-9)


def classes_of(known):
    """Word hash -> (count, class)."""
    out = {}
    for r in known.rows.collect():
        arrays = (np.frombuffer(getattr(r, c), k) for c, k in (("words", np.uint64), ("counts", np.uint64), ("classes", np.uint8)))
        out |= {int(w): (int(n), int(c)) for w, n, c in zip(*arrays, strict=True)}
    return out


def by_hand(rows, known, smoothing=brown.SMOOTHING):
    """Scores word by word from counts and classes alone."""
    classes, states, once = classes_of(known), Counter(), 0
    every = sorted({w for _, t in rows for w in words_of(t)})
    hashed = dict(zip(every, word_hashes([" ".join(every).encode()])[0].tolist(), strict=True))

    def line(text):
        return ["end", *(classes.get(hashed[w], (0, "new"))[1] for w in words_of(text)), "end"]

    for i, t in rows:
        if not is_held_out(i):
            chain = line(t)
            states.update(zip(chain, chain[1:]))
            for before, w in zip(chain, words_of(t)):
                states[before, "new"] += classes[hashed[w]][0] == 1
    sizes = Counter()
    for count, c in classes.values():
        sizes[c] += count
        once += count == 1
    share = {c: n for c, n in sizes.items()} | {"end": known.documents, "new": once + 1}
    whole = sum(share.values())
    after = Counter()
    for (before, _), n in states.items():
        after[before] += n

    def chance(before, state):
        return (states[before, state] + smoothing * share[state] / whole) / (after[before] + smoothing)

    for before in share:
        assert math.fsum(chance(before, s) for s in share) == pytest.approx(1)
    out = {}
    for i, t in rows:
        total = 0.0
        chain, own = line(t), words_of(t)
        for n, (before, state) in enumerate(zip(chain, chain[1:])):
            total += math.log10(chance(before, state))
            if state not in ("end", "new"):
                total += math.log10(classes[hashed[own[n]]][0] / sizes[state])
        out[i] = total
    return out


def test_given_documents(spark, small):
    docs, rows = documents(spark, small)
    found = brown.score(docs).collect()
    check_base(found, rows)
    known = brown.cluster(docs.where("crc32(cast(doc_id as string)) % 7 <> 2").select("text"))
    expected = by_hand(rows, known)
    assert [r.score for r in found] == pytest.approx([expected[r.doc_id] for r in found], rel=1e-9)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in found if r.perplexity < 1e300)


def test_parts_do_not_matter(spark, small):
    """Many units, partitions and, without an exchange, ranges give what one of each gives."""
    docs, _ = documents(spark, small)
    whole = {r.doc_id: r for r in brown.score(docs, range_bytes=1 << 40, unit_bytes=1 << 40, passes=1, rounds=0).collect()}
    parts = brown.score(docs.repartition(7), range_bytes=20_000, unit_bytes=30_000, passes=1, rounds=0).collect()
    assert len(parts) == len(whole)
    for r in parts:
        assert (r.n_tokens, r.n_known) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known)
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-9)


def test_held_out_texts_are_foretold_better_than_by_the_base(spark):
    docs, rows = documents(spark, "/root/testdata/sf0.01")
    found = brown.score(docs).collect()
    check_base(found, rows)
    held = [r for r in found if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    model, plain = (-sum(getattr(r, c) for r in held) / tokens for c in ("score", "base_score"))
    assert model < plain - 0.3


def test_classes_that_follow_each_other_are_found(spark):
    """Words of three kinds in turn: any order of the kinds but this one is far less likely."""
    rng = np.random.default_rng(7)
    kinds = [[f"{k}{rng.integers(10**6)}" for _ in range(40)] for k in ("x", "y", "z")]
    turn = lambda order: " ".join(rng.choice(kinds[k]) for _ in range(20) for k in order)
    ids = range(400)
    rows = [(i, turn((0, 1, 2)) if i < 200 or not is_held_out(i) else turn((0, 2, 1)), None, None) for i in ids]
    found = {r.doc_id: r for r in brown.score(odd(spark, rows)).collect()}
    right = [found[i].perplexity for i in ids if is_held_out(i) and i < 200]
    wrong = [found[i].perplexity for i in ids if is_held_out(i) and i >= 200]
    assert max(right) < 80 and min(wrong) > 4 * max(right)


def likelihood(totals):
    cells = totals[: brown._CELLS].astype(float)
    sizes = cells.reshape(brown._IDS, brown.CLASSES)[: brown._AROUND].sum(axis=0)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(cells) - 2 * f(sizes)


def some_range(seed=3, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}{'abcd'[i % 4]}" for i in range(words)]
    texts = [" ".join(rng.choice(vocabulary[i % 4 :: 4], 30)).encode() for i in range(40)]
    rows = list(brown.neighbours(texts, brown.Frequent(np.empty(0, np.uint64), np.empty(0, np.uint8)), 1))
    assert len(rows) == 1
    return brown.Range(*(np.frombuffer(a, k) for a, k in zip(rows[0][1:], brown._PART_KINDS, strict=True))), texts


def test_a_word_goes_where_the_likelihood_is_highest():
    known, _ = some_range()
    totals = known.totals()
    # One step for all but the last of the rarest words.
    moved = known.exchanged(totals, steps=1)
    changed = np.flatnonzero(moved != known.classes)
    assert len(changed) > 10
    last = np.lexsort((known.words, -known.counts.astype(np.int64)))[-1]
    for word in range(len(known.words)):
        if word == last:
            continue
        tried = []
        for c in range(brown.CLASSES):
            classes = known.classes.copy()
            classes[word] = c
            tried.append(likelihood(brown.Range(known.words, known.counts, classes, known.sizes, known.ids, known.values).totals()))
        if word in changed:
            assert tried[moved[word]] == pytest.approx(max(tried), rel=1e-6)
            assert tried[moved[word]] > tried[known.classes[word]]
        else:
            assert tried[known.classes[word]] == pytest.approx(max(tried), rel=1e-6)


def test_counts_of_neighbours():
    known, texts = some_range()
    counts = Counter(w for t in texts for w in t.split())
    by_hash = {int(word_hashes([w])[0][0]): n for w, n in counts.items()}
    assert dict(zip(known.words.tolist(), known.counts.tolist())) == by_hash
    # Each word has as many neighbours on a side as it has occurrences.
    left = known.ids < brown._AROUND
    for side in (left, ~left):
        sums = np.bincount(known.owner[side], weights=known.values[side].astype(float), minlength=len(known.words))
        assert (sums == known.counts).all()
    ends = known.values[known.ids == brown._END_OF_TEXT].sum()
    assert ends == len(texts) == known.values[known.ids == brown._IDS - 1].sum()


def test_rounds_raise_the_likelihood(spark, small):
    """In one range and in many that move at the same time."""
    docs, _ = documents(spark, small)
    for size in (1 << 40, 100_000):
        values = [likelihood(brown.cluster(docs.select("text"), passes=1, rounds=n, range_bytes=size).totals) for n in (0, 1, 2)]
        assert values[0] < values[1] < values[2]


def test_frequent_words_are_no_more_than_asked_for(spark, small):
    docs, rows = documents(spark, small)
    known = brown.cluster(docs.select("text"), passes=1, rounds=1)
    classes = classes_of(known)
    frequent = brown._frequent(known, 50)
    assert 20 < len(frequent.words) <= 50
    least = min(classes[int(w)][0] for w in frequent.words)
    assert sum(n >= least for n, _ in classes.values()) == len(frequent.words)
    assert [classes[int(w)][1] for w in frequent.words] == frequent.classes.tolist()


def test_odd_rows(spark):
    from odd import TEXTS

    rows = [(i, t) for i, t, *_ in TEXTS]
    check_base(brown.score(odd(spark)).collect(), rows)
    # Only rows that are not learned from, and none at all.
    held = [(i, "A b a", None, None) for i in range(60) if is_held_out(i)]
    found = brown.score(odd(spark, held)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(4, 0, 0, 0.0, 0.0)] * len(held)
    assert brown.score(empty(spark)).collect() == []
    without = [(i, t, None, None) for i in range(20) for t in (None, "", " \n")]
    found = brown.score(odd(spark, without)).collect()
    assert all(r.n_tokens == r.n_known == 1 and r.score < 0 for r in found) and len(found) == 60
