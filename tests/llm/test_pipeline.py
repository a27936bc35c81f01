"""Each stage against plain Python, on what the stage before it kept."""

import sys

import corpus_pipeline
from odd import empty, odd
from pyspark.sql import functions as F
from test_decontaminate import brute_force as holders_of_items
from test_linededup import key
from test_mixing import check as check_mix
from test_ngramjoin import brute_force as near_duplicates

from tiffinlake.llm import langid
from tiffinlake.llm.common import written


def plain_lines(rows, least=10):
    holders = {}
    for i, text in rows:
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    drop = {k for k, docs in holders.items() if k and len(docs) >= least}
    return {i: "\n".join(line for line in t.split("\n") if key(line) not in drop) for i, t in rows}


def test_stages_and_run(spark):
    folder = "/root/testdata/sf0.01"
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "test_items", "mix"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 500")
    docs = written(docs.unionByName(spark.createDataFrame([(9001, "日本語 テキスト", None, "s", 8), (9002, "12 34", "en", "s", 5)], docs.schema)), "documents")
    columns = docs.columns

    model = langid.fit(docs.where(~langid.held_out(3, 1)))
    kept = written(stages["language"](spark, docs, folder), "one")
    expected = {r.doc_id for r in docs.collect() if model.predict(r.text)[1] >= langid.LEAST_SCORE}
    assert {r.doc_id for r in kept.collect()} == expected
    assert not {9001, 9002} & expected and docs.count() - len(expected) == 2

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lines = written(stages["lines"](spark, kept, folder), "two")
    assert {r.doc_id: r.text for r in lines.collect()} == plain_lines(rows)
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0

    rows = [(r.doc_id, r.text) for r in lines.collect()]
    single = written(stages["near_duplicates"](spark, lines, folder), "three")
    classes = {c for _, c, _ in near_duplicates(rows)}
    assert {r.doc_id for r in single.collect()} == classes and single.count() == len(classes) < len(rows)

    rows = [(r.doc_id, r.text) for r in single.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = written(stages["test_items"](spark, single, folder), "four")
    held = {i for i, _ in holders_of_items(rows, items)}
    gone = {i for i, _ in rows} - {r.doc_id for r in clean.collect()}
    assert held and held <= gone and len(gone - held) <= 2
    for stage in (kept, lines, single, clean):
        assert stage.columns == columns

    mixed = stages["mix"](spark, clean, folder).collect()
    assert all(r.taken > 0 for r in mixed)
    check_mix(mixed + [r for r in corpus_pipeline.mixing.mix(clean).collect() if r.taken == 0])


def test_run_goes_over_all_documents(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(rows) <= spark.read.parquet(f"{small}/documents.parquet").count()
    assert len({r.doc_id for r in rows}) == len(rows)


def test_odd_rows(spark, small):
    for docs in (odd(spark), empty(spark)):
        docs = written(docs, "odd")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name != "mix":
                assert out.columns == docs.columns
                docs = written(out, "odd")
        assert out.count() <= docs.count()


def test_import_errors_are_not_swallowed(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "tiffinlake.llm.mixing", None)
    monkeypatch.delattr("tiffinlake.llm.mixing", raising=False)
    try:
        importlib.reload(corpus_pipeline)
        raise AssertionError("a missing operator went unnoticed")
    except ImportError:
        pass
    finally:
        monkeypatch.undo()
        importlib.reload(corpus_pipeline)
