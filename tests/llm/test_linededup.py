import hashlib
import re
from collections import defaultdict

from odd import documents, empty, odd

from tiffinlake.llm import linededup


def key(line):
    line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute_force(rows, min_docs, keep_first=False):
    holders = defaultdict(set)
    for i, (doc, text) in enumerate(rows):
        for line in text.split("\n"):
            holders[key(line)].add((doc, text))
    first, out = set(), []
    for doc, text in rows:
        kept = []
        for line in text.split("\n"):
            k = key(line)
            if not k or len(holders[k]) < min_docs:
                kept.append(line)
            elif keep_first and k not in first:
                first.add(k)
                kept.append(line)
        out.append((doc, text.count("\n") + 1, text.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, small):
    docs, rows = documents(spark, small)
    expected = brute_force(rows, 3)
    assert any(r[2] for r in expected)
    assert result(linededup.digests(docs, min_docs=3)) == expected
    assert result(linededup.digests(docs)) == brute_force(rows, 10)


def test_first_occurrences_stay(spark, small):
    docs, rows = documents(spark, small)
    assert result(linededup.digests(docs, min_docs=2, keep_first=True)) == brute_force(sorted(rows), 2, True)


def test_a_line_of_all_documents_over_many_partitions(spark, settings):
    settings({"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.enabled": "false"})
    rows = [(i, f"Common line\nown {i}\n common LINE \nrare {i // 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(linededup.digests(docs)) == brute_force(rows, 10)
    assert result(linededup.digests(docs, min_docs=2, keep_first=True)) == brute_force(rows, 2, True)


def test_odd_rows(spark):
    docs = odd(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert result(linededup.digests(docs, min_docs=3)) == brute_force(rows, 3)
    out = linededup.drop_common_lines(docs, min_docs=3)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    assert {r.n_chars for r in out.where("text is null").collect()} == {None}
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())
    assert linededup.digests(empty(spark)).collect() == []
    assert linededup.drop_common_lines(empty(spark)).collect() == []


def test_bitmaps_hold_no_text(spark):
    docs = spark.createDataFrame([(i, "same\n" * 5 + f"own {i}") for i in range(12)], "doc_id long, text string")
    found = linededup.keep_bitmaps(docs).collect()
    assert [r.n_dropped for r in found] == [5] * 12
    assert all(linededup.kept_lines(b"same\n" * 5 + b"own", r.keep) == [b"own"] for r in found)
