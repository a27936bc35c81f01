import hashlib
import re

import numpy as np
import pytest
from odd import documents, empty, odd
from pyspark.sql import functions as F

from tiffinlake.llm import substrings
from tiffinlake.llm.words import run_hashes, word_hashes


def brute_force(rows, window):
    first, out = {}, []
    order = sorted({(1 << 63 if i is None else i, t) for i, t in rows})
    split = {(i, t): re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for i, t in order}
    for (i, _), words in split.items():
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, text in rows:
        own = 1 << 63 if i is None else i
        words, keep = split[own, text], None
        keep = [True] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (own, s):
                keep[s : s + window] = [False] * window
        kept = [w for w, k in zip(words, keep) if k]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, small):
    docs, rows = documents(spark, small)
    expected = brute_force(rows, 20)
    assert any(0 < r[2] < r[1] for r in expected)
    assert result(substrings.digests(docs)) == expected


@pytest.mark.parametrize("pack", [50, 2_000_000])
def test_shifted_overlapping_and_periodic_repeats(spark, monkeypatch, pack):
    # Small packs: repeats are found between rows of a bucket and not only within a task.
    monkeypatch.setattr(substrings, "PACK", pack)
    random = np.random.default_rng(4)
    rows = []
    for i in range(60):
        words = [f"v{x}" for x in random.integers(0, 5000, int(random.integers(0, 90)))]
        passage = [f"p{k}" for k in range(int(random.integers(0, 30)), 30 + int(random.integers(0, 30)))]
        at = int(random.integers(0, len(words) + 1))
        words[at:at] = passage
        if i % 9 == 0:
            words += ["la"] * 50
        if i % 10 == 0:
            words += [f"c{k % 3}" for k in range(45)]
        rows.append((i * 7 % 60, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute_force(rows, 20)
    assert sum(r[2] for r in expected) > 1000
    assert result(substrings.digests(docs)) == expected


def test_ids_of_any_type_in_their_order(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [("b", f"one {passage}"), ("aa", f"{passage} two"), (None, passage), ("", "short"), ("Z" * 30, f"x {passage} y"), ("b", f"one {passage}")]
    for kind in ("string", "binary"):
        docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        found = {(None if r.doc_id is None else str(r.doc_id if kind == "string" else r.doc_id.decode())): r.n_removed for r in substrings.digests(docs).collect()}
        assert found == {"": 0, "Z" * 30: 0, "aa": 25, "b": 25, None: 25}
    docs = spark.createDataFrame([(2.5, passage), (-1.0, passage)], "doc_id double, text string")
    assert {r.doc_id: r.n_removed for r in substrings.digests(docs).collect()} == {-1.0: 0, 2.5: 25}


def test_a_bucket_is_as_large_at_any_size(spark, monkeypatch):
    """Twice the rows in twice the buckets: the largest group stays, and the result is right."""
    largest = {}
    for count in (400, 800):
        random = np.random.default_rng(count)
        rows = [(i, " ".join(f"v{x}" for x in random.integers(0, 1 << 40, 60))) for i in range(count)]
        rows += [(count + i, rows[i][1]) for i in range(0, 20)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        docs.persist()
        size = sum(len(t) for _, t in rows)
        assert substrings.buckets_for(docs, 8_000) == -(-size // 8_000) > 8
        buckets = substrings.buckets_for(docs, 8_000)
        keyed = docs.select("doc_id", *substrings.row_key("doc_id", "text"), "text")
        packed = keyed.select("_k1", "text").mapInArrow(substrings._anchors(20, buckets), substrings._PACKED)
        sizes = packed.groupBy("bucket").agg(F.sum(F.octet_length("hashes")).alias("n")).agg(F.max("n")).first()[0]
        largest[count] = sizes
        monkeypatch.setattr(substrings.with_repeats, "__defaults__", (20, 8_000))
        assert result(substrings.digests(docs)) == brute_force(rows, 20)
        monkeypatch.undo()
        docs.unpersist()
    assert largest[800] < 1.3 * largest[400]


def test_any_long_match_shares_an_anchor():
    for a in range(substrings.PERIOD):
        for b in range(substrings.PERIOD):
            assert any(
                (a + d) % substrings.PERIOD in substrings.COVER and (b + d) % substrings.PERIOD in substrings.COVER
                for d in range(substrings.PERIOD)
            )


def test_odd_rows(spark):
    docs = odd(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert result(substrings.digests(docs, window=13)) == brute_force(rows, 13)
    out = substrings.remove_repeats(docs, window=13)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[4] == "" and texts[8] == "a\n\n  A \n\x0b"
    assert substrings.digests(empty(spark)).collect() == []
    assert substrings.remove_repeats(empty(spark)).collect() == []


def test_hashes_of_words_do_not_depend_on_their_place():
    texts = [b"one two\tthree", b"", b"  zzz one two three ", "é日".encode()]
    hashes, begins = word_hashes(texts)
    assert begins.tolist() == [0, 3, 3, 7, 8]
    assert hashes[:3].tolist() == hashes[4:7].tolist() and len(set(hashes.tolist())) == 5
    runs = run_hashes(hashes, 3)
    assert runs[0] == runs[4] and len(set(runs.tolist())) == 5
    assert len(run_hashes(hashes, 9)) == 0
