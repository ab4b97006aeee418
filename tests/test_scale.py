"""Steps that tables of millions of rows go through: no list is walked for each word, no row is made for each pair."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import attributes as A
from quillon.operators import coherence as C
from quillon.operators import content as V
from quillon.operators import graph
from quillon.plans import registry
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["windows", "stopword_ratio", "dale_chall"])
def test_word_lists_are_sets(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "array_contains" not in text and "INSET" in text


def test_terms_are_filtered_by_a_set(spark):
    text = plan(V.terms(spark.createDataFrame([(1, "the cat")], "doc_id long, text string")))
    assert "array_contains" not in text and "INSET" in text


TOKENS = ["the", "is", "who", "running", "ing", "éting", "x_ing", "red", "ed", "9", "99", "٣", "9a", "ly", "quickly", "best", "est", "er", "taller", "able", "al", "class", "cats", "s", "ßs", "...", "—", "_", "€5", "{}", "~", "¿", "été", "ébed", ""]


def test_hints_change_no_tag(spark):
    def plain(t):
        if t in T.PUNCTUATION:
            return t
        for name, words in A.CLOSED:
            if t in words.split():
                return name
        for name, shape in A.SHAPES:
            letters = "".join(sorted({c for c in t if c.isalpha()}))
            own = shape.replace(r"[^\p{L}\p{N}_]", r"[^\w]").replace(r"\p{L}", re.escape(letters) or "a")
            if re.search(own, t):
                return name
        return "NN"

    got = spark.createDataFrame([(TOKENS,)], "t array<string>").select(A.rule_tags(F.col("t")).alias("g")).first()["g"]
    assert got == [plain(t) for t in TOKENS]


def test_tags_are_counted_in_one_line(spark):
    df = spark.createDataFrame([(["NN", "NN", "NN", "NNS", "N", ".", "WP$"],), ([],), (["NN"],)], "tags array<string>")
    got = df.select(*[A._tag_count(n).alias(str(i)) for i, n in enumerate(("NN", "NNS", "WP$", "VB"))]).collect()
    assert [tuple(r) for r in got] == [(3, 1, 1, 0), (0, 0, 0, 0), (1, 0, 0, 0)]


@pytest.mark.parametrize("size", [0, 1, 3, 7, 40])
def test_points_by_position_are_the_vectors_of_the_windows(size):
    rng = random.Random(size)
    for n in (0, 1, 2, 5, 30, 120):
        words = [rng.choice(["a", "bb", "c_c", "dd", "€€", "__", "ee", "—"]) for _ in range(n)]
        x, y = C.points(words, size), C.vectorize(C.cut(words, size))
        assert x.shape == y.shape and np.allclose(np.sort(x, axis=1), np.sort(y, axis=1), atol=1e-12)
        a, b = C.statistics(x), C.statistics(y)
        assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in C.NAMES)


def test_single_measures_are_those_of_all():
    x = np.abs(np.random.default_rng(3).normal(size=(9, 4)))
    x[2] = 0
    every = C.statistics(x)
    assert all(C.statistics(x, [n])[n] == pytest.approx(every[n]) for n in C.NAMES)


def test_vector_totals_are_those_of_the_long_form(spark):
    texts = ["cat dog cat sun " * 30, "—", "", None, "red sun"]
    words = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", C.content_words(F.col("text")).alias("words"))
    size = C.window_size(words)
    long = C.window_vectors(C.windows(words, size)).groupBy("doc_id").agg(F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_weights"), F.sum("w").alias("total"))
    of = lambda df: {r["doc_id"]: (r["n_terms"], r["n_weights"], round(r["total"], 9)) for r in df.collect()}
    assert of(C.vector_totals(words, size)) == of(long)


def test_cosine_by_counts_is_that_by_weights(spark):
    counts = V.terms(spark.createDataFrame([(-1, "red sun red"), (1, "sun moon"), (2, "green"), (3, "red sun red")], "doc_id long, text string"))
    of = lambda df: {r["doc_id"]: round(r["cosine"], 9) for r in df.collect()}
    assert of(V.cosine_source(counts, -1)) == of(V.cosine_with(V.tfidf(counts), -1))
    assert of(V.cosine_source(counts, -9)) == {-1: 0.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_nearest_by_tiles_is_that_of_all_pairs(spark, monkeypatch):
    for name, value in (("TILE", 60), ("DENSE", 2), ("TOGETHER", 3)):
        monkeypatch.setattr(V, name, value)
    rng = random.Random(4)
    docs = {i: {rng.choice("abcdefghijklmn"): rng.choice([0.25, 0.5, 1.0]) for _ in range(rng.randint(1, 6))} for i in range(40)} | {90: {"zz": 1.0}, 91: {"zz": 0.5}, 92: {"alone": 1.0}}
    grades = {i: i % 4 for i in docs if i % 5}
    weights = spark.createDataFrame([(d, t, w) for d, v in docs.items() for t, w in v.items()], "doc_id long, term string, w double")
    expected = {}
    for d, v in docs.items():
        met = [(-round(sum(w * docs[e][t] for t, w in v.items() if t in docs[e]), 9), e) for e in grades if e != d and v.keys() & docs[e].keys()]
        if met:
            c, e = min(met)
            expected[d] = (e, -c, float(grades[e]))
    got = V.nearest(weights, spark.createDataFrame(list(grades.items()), "doc_id long, grade int"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == expected


def test_a_clause_is_matched_once(spark):
    texts = ["Lisa likes tennis. The cat does not like\x01 dogs! Tom sees\na dog.", "\x02Lisa likes tennis.", "Kim is Kim. Kim's dog sat ", "", None]
    found = graph.triples(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert plan(found).lower().count("(?i)^") == 1
    said = {tuple(r) for r in found.collect()}
    assert {(0, 0, "lisa", "likes", "tennis"), (0, 2, "tom", "sees", "dog"), (2, 1, "kim's", "dog", "sat")} <= said
    assert {r[0] for r in said} == {0, 2}
