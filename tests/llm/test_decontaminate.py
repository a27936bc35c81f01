import numpy as np
import pytest
from odd import PROSE, documents, empty, odd

from tiffinlake.llm import decontaminate as d


def items_of(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def brute_force(rows, items):
    """(doc, item) whose words are in the document in one piece."""
    found = set()
    spaced = [(i, " " + " ".join(d.words_of(t)) + " ") for i, t in rows]
    for item_id, text in items:
        needle = " " + " ".join(d.words_of(text)) + " "
        found |= {(i, item_id) for i, t in spaced if needle in t}
    return found


def test_finds_the_whole_items_in_the_documents(spark, small):
    docs, rows = documents(spark, small)
    items = items_of(spark, small)
    planted = brute_force(rows, [(r.item_id, r.text) for r in items.collect()])
    found = {(r.doc_id, r.item_id): r for r in d.matches(docs, items).collect()}
    assert planted and planted <= set(found)
    for pair in set(found) - planted:
        assert min(found[pair][3:5]) >= d.OVERLAP
    assert len(set(found) - planted) <= 2
    clean = d.remove_contaminated(docs, items)
    assert clean.schema == docs.schema
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_parts_of_the_items_find_the_same(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), items_of(spark, small)
    whole = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in d.matches(docs, items).collect())
    parts = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in d.matches(docs, items, index_words=200).collect())
    assert whole == parts
    assert d.parts_of(items, 200)[0] > 1
    kept = [sorted(r.doc_id for r in d.remove_contaminated(docs, items, index_words=n).collect()) for n in (d.INDEX_WORDS, 200)]
    assert kept[0] == kept[1] and len(kept[0]) == docs.count() - len({r[0] for r in whole})


def test_an_index_is_built_when_it_is_asked_for(spark, small):
    """One part after another, in a task each, and all items in one of them."""
    items = items_of(spark, small)
    parts = d.indexes(items, 200)
    first = next(parts)
    count = d.parts_of(items, 200)
    assert count[0] > 1 and sum(len(i.words) for i in first.items) < 600
    found = [i.item_id for i in first.items] + [i.item_id for index in parts for i in index.items]
    assert sorted(found) == sorted(r.item_id for r in items.where("text IS NOT NULL").distinct().collect())
    assert count[1] == len(found)


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.5])
def test_wand_equals_scoring_everything(threshold):
    random = np.random.default_rng(2)
    items = [d.Item(i, [f"t{x}" for x in random.zipf(1.4, 30) % 80], 20) for i in range(60)]
    frequent = {}
    for item in items:
        for word in set(item.words):
            frequent[word] = frequent.get(word, 0) + 1
    index = d.Index(items, frequent, len(items), 30.0)
    found, expected = set(), set()
    for p in range(40):
        terms = np.unique(random.choice(len(index.ids), 25))
        scores = np.zeros(len(items))
        hit = np.isin(index.term, terms)
        np.add.at(scores, index.item[hit], index.weight[hit])
        expected |= {(p, int(i)) for i in np.flatnonzero(scores >= threshold)}
        for _, block in zip(*index.open_blocks(np.zeros(len(terms), np.int64), terms, threshold), strict=True):
            for item, score in index.search_block(terms, int(block), threshold):
                assert score == pytest.approx(scores[item])
                found.add((p, item))
    assert found == expected
    assert expected or threshold > 0.2


def test_edits_are_found_and_other_text_is_not(spark):
    item = "Who wrote the long poem about the grey sea and the old mill? It was written by Ada Stone in 1901."
    edited = item.replace("grey", "green").upper()
    rows = [
        (1, f"Some words before. {item} And after."),
        (2, "x " * 500 + edited + " y" * 500),
        (3, "Who wrote the long poem about the grey sea and the old mill? It was Bob."),
        (4, PROSE),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, " "), (9, item)], "item_id long, text string")
    assert {r.doc_id for r in d.matches(docs, items).collect()} == {1, 2}
    assert {r.doc_id for r in d.remove_contaminated(docs, items).collect()} == {3, 4}


@pytest.mark.parametrize("edit", ["replaced", "left out", "put in"])
def test_an_edit_anywhere_costs_only_its_own_word(spark, small, edit):
    for index in d.indexes(items_of(spark, small)):
        for item in index.items[::4] + [i for i in index.items if len(i.words) - i.question == 1]:
            texts = []
            for k in range(len(item.words)):
                put, rest = ([] if edit == "left out" else ["zzzz"]), item.words[k + (edit != "put in") :]
                texts.append(" ".join(["before"] * 9 + item.words[:k] + put + rest + ["behind"] * 9))
            found = {r[0] for r in d.find(index, texts, d.THRESHOLD, d.OVERLAP) if r[1] == item.item_id}
            assert found == set(range(len(texts))), item


def test_edits_of_all_kinds_in_an_item_cost_their_own_words():
    words = [f"w{i}" for i in range(40)]
    item = d.Item(1, words, 30)
    # Four words in a row replaced in the question, two left out of the answer, the one behind them still counts.
    edited = words[:26] + ["x"] * 4 + words[30:37] + words[39:]
    assert d.covered(item, ["y"] * 50 + edited + ["y"] * 50) == (26 / 30, 8 / 10)
    assert d.covered(item, words[30:] + ["y"] * 20 + words[:30]) == (1, 1)
    # Equal words spread over a passage, however many and in order, are no item.
    spread = [w for word in words for w in (word, "y", "y")]
    assert d.covered(item, spread) == (0, 0)
    # The question does not pay for words of the answer far behind it.
    assert d.covered(item, words[:30] + ["y"] * 30 + words[30::4])[1] == 0


def test_another_answer_is_not_the_item():
    item = d.Item(1, d.words_of("Who wrote the long poem about the grey sea and the mill? Ada Stone did"), 12)
    other = d.words_of("Who wrote the long poem about the grey sea and the mill? Bob Flint did")
    assert d.covered(item, item.words) == (1, 1)
    assert d.covered(item, other)[0] == 1 and d.covered(item, other)[1] < d.OVERLAP
    assert d.covered(d.Item(2, item.words[:4], 3), item.words[:3]) == (0, 0)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, PROSE), (None, "a short one")], "item_id long, text string")
    docs = odd(spark)
    found = sorted((str(r.doc_id), r.item_id) for r in d.matches(docs, items).collect())
    assert found == [("1", 1), ("2", 1), ("2", 1), ("None", 1)]
    clean = d.remove_contaminated(docs, items)
    assert clean.schema == docs.schema and clean.count() == docs.count() - 4
    assert d.matches(empty(spark), items).collect() == []
    assert d.matches(docs, items.limit(0)).collect() == []
    assert d.remove_contaminated(docs, items.limit(0)).count() == docs.count()
    by_part = d.remove_contaminated(docs, items, index_words=4)
    assert by_part.schema == docs.schema and sorted(map(str, by_part.collect())) == sorted(map(str, clean.collect()))
