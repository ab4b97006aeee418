import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import toxicity as X
from tests.llm import brute
from tests.oracle import DATA


def accepted(machine, word):
    points = np.array([ord(c) for c in word], np.int64)
    _, term, edits = X.run(machine, points, np.array([0]), np.array([len(points)]))
    return (int(term[0]), int(edits[0])) if len(term) else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=6, unique=True), st.lists(st.text("abcd", min_size=1, max_size=6), max_size=12), st.data())
def test_automaton_equals_edit_distance(terms, words, data):
    budget = [data.draw(st.integers(0, 1)) for _ in terms]
    machine = X.build(terms, budget)
    for w in words + terms:
        near = [(brute.edits(w, t), i) for i, t in enumerate(terms) if brute.edits(w, t) <= budget[i]]
        got = accepted(machine, w)
        assert (got is None) == (not near)
        if got is not None:
            assert got[1] == min(near)[0] and (got[1], got[0]) in near


def test_quotation_and_address_change_the_weight():
    plain, _ = X.context("what an ", " this is", 0)
    quoted, is_quoted = X.context('he said "what an ', '" yesterday', 0)
    addressed, _ = X.context("you are an ", " ok", 0)
    assert is_quoted and quoted < plain < addressed


@pytest.fixture(scope="module")
def scored(spark):
    sf = f"{DATA}/sf0.1"
    rows = X.op7_toxicity(spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([p == y for p, y in held]) >= 0.9
    ones = [p for p, y in held if y]
    assert np.mean(ones) >= 0.9  # some labels mark texts without any abuse


def test_contract(spark, scored):
    rows, _ = scored
    assert len(rows) == spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_misspelled_terms_and_clean_texts(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a moron"), (2, "you are an idjot and a morron"), (3, "we had a lovely walk"), (4, None), (5, ""), (6, "fine " * 300000), (6, "x")], "doc_id long, text string")
    docs = docs.selectExpr("*", "0 AS score", "0 AS y")
    model = X.fit(docs, spark.createDataFrame([(99, None)], "doc_id long, toxic int"))
    out = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in X.scored(docs, model).collect()))
    assert [p for *_, p in out] == [1, 1, 0, 0, 0, 0, 0]
    assert out[3][1] == out[4][1] == pytest.approx(1 / (1 + np.exp(-model.coefficients[0])))
    empty = spark.createDataFrame([], docs.schema)
    assert X.scored(empty, model).count() == 0
    X.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))


def test_held_out_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"you absolute blockhead {i}" if i % 2 else f"a quiet day {i}") for i in range(120)], "doc_id long, text string")
    from quillon.llm.quality import is_held_out

    one = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, 1 - i % 2 if is_held_out(i) else i % 2) for i in range(120)], "doc_id long, toxic int")
    a, b = X.fit(docs, one), X.fit(docs, other)
    assert np.array_equal(a.coefficients, b.coefficients) and np.array_equal(a.machine.step, b.machine.step)


def test_scores_do_not_depend_on_batches():
    model = X.Model(X.build(["idiot", "scum"], [1, 0]), np.array([2.0, 1.0]), X.DEFAULT)
    texts = ["you idiot", None, "", "scum\nscum", 'he said "scum"', "é idyot é"]
    whole = model.scores(pa.array(texts))
    assert np.allclose(whole, [model.scores(pa.array([t], pa.string()))[0] for t in texts])


@pytest.mark.parametrize("text", ["“scum”", "‘scum’", "scum—you", "you…scum", "ДУРАК", "（дурак）", "λόγος", "ΛΌΓΟΣ", "「笨蛋蛋」", "مجنون؟"])
def test_terms_in_all_scripts_and_beside_all_signs(text):
    machine = X.build(["scum", "дурак", "λόγος", "笨蛋蛋", "مجنون"], [0] * 5)
    hits, n = X.found_in(machine, pa.array([text]))
    assert len(hits[0]) == 1 and {quoted for *_, quoted in hits[0]} == {text == "“scum”"}
    assert n[0] == 1 + ("you" in text)


def plain(model, terms, budget, text):
    """The score of a text, word by word over all terms."""
    text = text or ""
    words, at = [], None
    for i, c in enumerate(text + " "):
        if X._WORDLIKE[ord(c)]:
            at = i if at is None else at
        elif at is not None:
            words.append((at, i))
            at = None
    hits = []
    for a, b in words:
        near = [(brute.edits(text[a:b].lower(), t), i) for i, t in enumerate(terms) if brute.edits(text[a:b].lower(), t) <= budget[i]]
        if near:
            hits.append((a, b, *min(near)))
    sums = [0.0, 0.0]
    for a, b, e, t in hits:
        around = sum(abs(a - x) <= X.WINDOW for x, *_ in hits) - 1
        weight, quoted = X.context(text[max(0, a - X.WINDOW) : a], text[b : b + X.WINDOW], around)
        sums[quoted] += model.value[t] * weight * (X.MISSPELLED if e else 1)
    x = np.log1p([*sums, 100 * sums[0] / max(len(words), 20)])
    return 1 / (1 + np.exp(-np.clip(model.coefficients[0] + x @ model.coefficients[1:], -30, 30)))


TERMS, BUDGET = ["idiot", "scum", "дурак", "moron"], [1, 0, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "idjot", "idiots", "scum", "scums", "дурак", "дурок", "you", "said", '"', "“", "”", "\n", " ", " ", ", ", "fine", "漢字", "é", "x" * 40]), max_size=60))
def test_score_equals_the_plain_one_however_it_is_cut(parts):
    text = "".join(parts)
    model = X.Model(X.build(TERMS, BUDGET), np.array([2.0, 1.0, 1.5, 0.7]), X.DEFAULT)
    want = plain(model, TERMS, BUDGET, text)
    assert model.scores(pa.array([text]))[0] == pytest.approx(want)
    whole, n = X.found_in(model.machine, pa.array(["", text, text]))
    for limit in (16, 50, 333):
        cut, m = X.found_in(model.machine, pa.array(["", text, text]), limit)
        assert list(m) == list(n) and [x.keys() for x in cut] == [x.keys() for x in whole]
        assert all(c[k] == pytest.approx(w[k]) for c, w in zip(cut, whole, strict=True) for k in w)


@pytest.mark.parametrize("text", ["a" + "é" * 700000, "漢" * 400000, "é" * 600000 + " idiot", "😀" * 200000 + "idiot"])
def test_long_texts_without_spaces(text):
    model = X.Model(X.build(TERMS, BUDGET), np.ones(4), X.DEFAULT)
    none = 1 / (1 + np.exp(-X.DEFAULT[0]))
    assert (model.scores(pa.array([text]))[0] > none) == text.endswith("idiot")
