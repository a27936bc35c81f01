import zlib
from collections import Counter

from odd import documents, empty, odd

from tiffinlake.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = dict(map(tuple, docs.select("doc_id", "lang").collect()))
    found = [r for r in langid.identify(docs).collect()]
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    tested = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert sum(tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_profiles_equal_plain_counting(spark, small):
    docs, _ = documents(spark, small)
    counts = {}
    for r in docs.collect():
        if r.lang and r.text is not None:
            spaced = "".join(c if c.isalpha() else " " for c in r.text.lower())
            text = "_" + "_".join(spaced.split()) + "_" if spaced.split() else "_"
            own = counts.setdefault(r.lang, Counter())
            for n in (1, 2, 3):
                own.update(g for i in range(len(text) - n + 1) if (g := text[i : i + n]) != "_")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    for lang, own in counts.items():
        expected = sorted(((-n, code(g)) for g, n in own.items()))[:400]
        got = langid.profiles(docs).where(f"lang = '{lang}'").orderBy("rank").collect()
        assert [r.gram for r in got] == [c for _, c in expected]


def test_odd_rows(spark):
    docs = odd(spark)
    model = langid.fit(docs)
    out = langid.predict(docs, model)
    assert out.count() == docs.count()
    for r in out.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    assert {r.lang_pred for r in out.where("doc_id = 7").collect()} == {"de"}
    kept = langid.reject_unknown(docs)
    assert kept.schema == docs.schema
    assert {1, 2, 6, 7} <= {r.doc_id for r in kept.collect()}
    assert not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()}
    assert langid.identify(empty(spark)).collect() == []
    assert langid.reject_unknown(empty(spark)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.source.substr(9, 1)).limit(3)).collect()} <= {"und", ""}
