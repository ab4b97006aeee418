import numpy as np
import pytest

from quillon.llm import decontaminate as D

VOCABULARY = [f"w{a}{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]


def score(item, text):
    """Best local alignment over the whole text, cell by cell, over the score of a verbatim copy."""
    a, b = item.lower().split(), text.lower().split()
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, row[-1] - 1))
        best, last = max(best, *row), row
    return best / (2 * len(a))


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    items = [(k, " ".join(rng.choice(VOCABULARY, int(rng.integers(12, 40))))) for k in range(12)]
    docs, truth = [], set()
    for i in range(60):
        words = list(rng.choice(VOCABULARY, 150))
        if i % 3 == 0:
            k = int(rng.integers(12))
            copy = items[k][1].split()
            for at in rng.choice(len(copy), (i // 3) % 4, replace=False):  # none to three edits
                copy[at] = "edited"
            at = int(rng.integers(150))
            words[at:at] = copy
        docs.append((i, " ".join(words)))
        truth |= {(i, k) for k, t in items if score(t, docs[-1][1]) >= D.THRESHOLD}
    return items, docs, truth


def test_equals_full_alignment(spark, planted):
    items, docs, truth = planted
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth and len(got) == len(truth)
    text = dict(docs)
    for r in got:
        assert r["score"] == pytest.approx(score(dict(items)[r["item_id"]], text[r["doc_id"]]))
        own = text[r["doc_id"]].split()[r["first_word"] : r["end_word"]]
        assert score(dict(items)[r["item_id"]], " ".join(own)) == pytest.approx(r["score"])


def test_waves_give_the_same(spark, planted, monkeypatch):
    items, docs, truth = planted
    monkeypatch.setattr(D, "WAVE_BYTES", 300)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()} == truth
    kept = {r["doc_id"] for r in D.remove(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in truth}


def test_edited_copies_without_a_verbatim_one(spark):
    """15 to 30 % of the words replaced, at chance or evenly: most seeds of a copy are gone, and some texts hold others of them."""
    rng = np.random.default_rng(12)
    items = [(k, " ".join(rng.choice(VOCABULARY, n))) for k, n in enumerate([20, 39, 59] * 4)]
    docs = []
    for i in range(72):
        copy = items[i % 12][1].split()
        share = (0.15, 0.2, 0.25, 0.3)[i % 4]
        gone = range(i % 5, len(copy), 5) if i >= 60 else rng.choice(len(copy), round(share * len(copy)), replace=False)
        for at in gone:
            copy[at] = f"edited{i}x{at}"
        docs.append((i, " ".join([*rng.choice(VOCABULARY, 30), *copy, *rng.choice(VOCABULARY, 30)])))
    runs = {k: {" ".join(w[at : at + 3]) for at in range(len(w) - 2)} for k, w in ((k, t.split()) for k, t in items)}
    truth = {(i, k) for i, text in docs for k, t in items if score(t, text) >= D.THRESHOLD and any(f" {r} " in f" {text} " for r in runs[k])}
    assert len(truth) > 60
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()} == truth
    assert {r["doc_id"] for r in D.remove(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in truth}


def test_copy_with_many_words_put_in(spark):
    """The words put in before the only seed move it by more than half the item."""
    item = [f"i{k}" for k in range(20)]
    text = " ".join(["x", *(w for k in range(15) for w in (item[k], f"y{k}")), *item[15:], "z"])
    assert score(" ".join(item), text) >= D.THRESHOLD
    got = D.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, score(" ".join(item), text))]


def test_passage_that_most_documents_share(spark):
    rng = np.random.default_rng(2)
    item = " ".join(rng.choice(VOCABULARY, 30))
    docs = [(i, " ".join([*rng.choice(VOCABULARY, 40), *(item.split() if i % 10 else []), *rng.choice(VOCABULARY, 40)])) for i in range(80)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {i for i in range(80) if i % 10}


def test_copy_across_pieces_of_a_long_text(spark):
    rng = np.random.default_rng(4)
    item = " ".join(rng.choice(VOCABULARY, 40))
    filler = " ".join(rng.choice(VOCABULARY, 200_000))
    cut = filler.index(" ", (1 << 19) - 100)
    docs = [(1, filler[:cut] + " " + item + filler[cut:]), (2, filler)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    before = len(docs[0][1][:cut].split())
    assert [tuple(r) for r in got.collect()] == [(1, 5, 1.0, before, before + 40)]


def test_words_are_counted_from_the_start_of_long_texts(spark):
    filler = "some other words, " * 150_000
    docs = [(1, filler + "what is the capital of France? " + filler), (2, filler)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, "What is the capital of France?")], "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 5, 1.0, 450_000, 450_006)]


def test_short_items_are_found_verbatim(spark):
    docs = [(1, "Q: What is the capital of France? A: Paris."), (2, "What is the capital of Spain, then?"), (3, "paris, texas"), (4, "nothing here"), (5, "to be or not")]
    items = [(1, "What is the capital of France?"), (2, "Paris"), (3, "Paris, Texas"), (4, "to be or not to be"), (5, "!!")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.leaks(df, bench).collect()) == [(1, 1), (1, 2), (3, 2), (3, 3)]
    assert sorted(r["doc_id"] for r in D.remove(df, bench).collect()) == [2, 3, 4, 5]


def test_defined_cases(spark):
    item = "the quick brown fox jumps over the lazy dog tonight"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, item.upper() + "!", 1), (3, item, 1), (None, item, 1), (4, "the quick brown fox", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "too short"), (None, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in D.leaks(docs, bench).collect())
    assert got == sorted([(d, i) for d in (3, 3, -1) for i in (1, 2, -1)])
    kept = D.remove(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    nothing = spark.createDataFrame([], docs.schema)
    assert D.leaks(nothing, bench).count() == D.remove(nothing, bench).count() == 0
    assert D.leaks(docs, spark.createDataFrame([], bench.schema)).count() == 0
    assert D.remove(docs, spark.createDataFrame([], bench.schema)).count() == 6
