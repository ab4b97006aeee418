"""Values of measures worked out by hand, and degenerate texts."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import attributes as A

TENNIS = "Tennis is a fast sport. Lisa doesn't like fast sports. Lisa likes tennis. Lisa is a man."


@pytest.fixture(scope="module")
def tennis(spark):
    rows = [(1, TENNIS), (2, None), (3, ""), (4, "!!! ..."), (5, "word"), (6, "a b. c d. e f."), (7, "the the the the"), (8, "é😀 x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("words", F.lit("x"))
    return {r["doc_id"]: r.asDict() for r in A.measures(docs).collect()}


EXPECTED = {
    "numberOfCharacters": 88, "numberOfCharactersNoSpaces": 72, "numberOfWords": 18, "numberOfSentences": 4, "numberOfDifferentWords": 14,
    "numberOfShortWords": 11 / 23, "numberOfLongWords": 0, "mostFrequentWordLength": 1, "averageWordLength": 72 / 23,
    "mostFrequentSentenceLength": 5, "averageSentenceLength": 4.5, "numberOfShortSentences": 1, "numberOfLongSentences": 0,
    "typeTokenRatio": 0.7777777777777778, "guiraudsIndex": 3.299831645537222, "yulesK": 1388.888888888889, "theDEstimate": 31.305555555555557,
    "hapaxLegomena": 7 / 18, "automatedReadabilityIndex": -1, "gunningFogIndex": 1.8, "lix": 4.5, "wordVariationIndex": 34.66732380864529,
}


@pytest.mark.parametrize("name", EXPECTED)
def test_worked_example(tennis, name):
    assert tennis[1][name] == pytest.approx(EXPECTED[name], rel=1e-9)


def test_column_names_and_order(spark):
    names = [n for g in A.GROUPS for n in A.group(g)]
    assert [len(A.group(g)) for g in A.GROUPS] == [14, 9, 6, 38]
    assert A.measures(spark.createDataFrame([], "doc_id long, text string")).columns == ["doc_id", *names]


@pytest.mark.parametrize("doc", [2, 3])
def test_empty_texts_have_no_ratios(tennis, doc):
    assert tennis[doc]["numberOfCharacters"] == 0
    assert tennis[doc]["averageWordLength"] is None
    assert tennis[doc]["mostFrequentWordLength"] is None
    assert tennis[doc]["wordVariationIndex"] == 0
    assert tennis[doc]["nominalRatio"] == 0


def test_runs_of_punctuation_are_words(tennis):
    # "!!!" and "..." are no parts of the punctuation string, single marks are.
    assert tennis[4]["numberOfWords"] == 2
    assert tennis[6]["numberOfWords"] == 6
    assert tennis[6]["numberOfDifferentWords"] == 7


def test_one_word(tennis):
    assert tennis[5]["typeTokenRatio"] == 1
    assert tennis[5]["theDEstimate"] == 0
    assert tennis[5]["wordVariationIndex"] == 0


def test_long_text_counts_code_points(tennis):
    assert tennis[8]["numberOfCharacters"] == 5 * 3000
    assert not math.isnan(tennis[8]["lix"])


def test_wp_column_holds_possessives(spark):
    docs = spark.createDataFrame([(1, "who whose whose what")], "doc_id long, text string")
    row = A.measures(docs, ("grammar",)).first()
    assert row["pos_WP"] == 2


def test_tree_height(spark):
    rows = [([],), ([0],), ([2, 0, 2],), ([0, 1, 2, 3],)]
    out = spark.createDataFrame(rows, "h array<int>").select(A.tree_height(F.col("h"))).collect()
    assert [r[0] for r in out] == [0, 1, 2, 4]


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("table", 2), ("walked", 1), ("beautiful", 3), ("mcdonald", 3), ("happy", 2), ("whole", 1), ("serious", 3)])
def test_syllables(spark, word, n):
    assert spark.range(1).select(T.syllables(F.lit(word))).first()[0] == n


def test_errors(spark):
    docs = spark.createDataFrame([(1, "hello , World. i am,here. ok"), (2, None)], "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(A.capitalization_errors(text), A.punctuation_errors(text)).collect()
    assert [tuple(r) for r in rows] == [(4, 2), (0, 0)]
    lexicon = spark.createDataFrame([("hello",), ("am",), ("i",)], "word string")
    own = {r[0]: r[1] for r in A.spelling_errors(A.prepare(docs), lexicon).collect()}
    assert own == {1: 3, 2: 0}


def test_mode_takes_the_first_seen(spark):
    df = spark.createDataFrame([([3, 1, 1, 3],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(T.mode_first(F.col("a"))).collect()] == [3, None]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.camel_words(F.lit("hasBigDog"))) == "has big dog"
    assert one(T.fragment(F.lit("http://x/y#Dog"))) == "Dog"
    assert one(T.sense_name(F.lit("dog1n"))) == "dog.n.01"
    assert one(T.class_name(F.lit("big dog"))) == "BigDog"
    assert one(T.property_name(F.lit("has part"))) == "hasPart"
    assert one(T.wordnet_pos(F.lit("JJR"))) == "a"
    assert one(T.expand_contractions(F.lit("isn't"))) == "is not"
    assert one(T.is_number(F.lit("nan"))) is False
    assert one(T.clip_prediction(F.lit(501.0))) == 0.0
    assert one(T.euclidean(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 5.0
