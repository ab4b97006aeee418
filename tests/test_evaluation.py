import numpy as np
import pytest

from quillon.operators import evaluation, selection


def matrix_kappa(a, b):
    """Kappa from the matrices of observed and expected ratings."""
    low, high = min(min(a), min(b)), max(max(a), max(b))
    size = high - low + 1
    seen = np.zeros((size, size))
    for x, y in zip(a, b, strict=True):
        seen[x - low, y - low] += 1
    weight = np.array([[(i - j) ** 2 for j in range(size)] for i in range(size)], float)
    expected = np.outer(seen.sum(1), seen.sum(0)) / len(a)
    return 1 - (weight * seen).sum() / (weight * expected).sum()


@pytest.mark.parametrize("seed", range(4))
def test_kappa_equals_its_matrix_form(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, 80).tolist(), rng.integers(0, 5, 80).tolist()
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert df.agg(evaluation.kappa(df["a"], df["b"])).first()[0] == pytest.approx(matrix_kappa(a, b), abs=1e-12)
    assert df.agg(evaluation.kappa(df["a"], df["a"])).first()[0] == 1


def test_equal_ratings_have_no_kappa(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert df.agg(evaluation.kappa(df["a"], df["b"])).first()[0] is None


def test_scores(spark):
    rows = [(1.0, 1.5, 0), (2.0, 2.5, 0), (3.0, 1.0, 1), (0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "true double, predicted double, fold int")
    out = evaluation.score_predictions(df).first()
    assert out["exactAgreement"] == 0.5  # halves go to the even number
    assert out["exactAgreementFolds"] == pytest.approx((0.5 + 0.0) / 2)


def test_grade_is_the_last_number_of_the_first_row(spark):
    rows = [(2, "b", 3.0, None), (1, "a", 10.0, float("nan"))]
    df = spark.createDataFrame(rows, "id int, essay string, grade double, extra double")
    assert evaluation.detect_grade(df, "id") == "grade"
    assert evaluation.detect_grade(df.select("id", "essay"), "id") is None
    assert evaluation.choose_columns(df.withColumnRenamed("extra", "Linear Regression")) == "Linear Regression"


@pytest.mark.parametrize(("even", "sizes"), [(False, [2, 2, 2, 2, 2, 1]), (True, [3, 2, 2, 2, 2])])
def test_folds(spark, even, sizes):
    df = spark.range(11).withColumnRenamed("id", "doc_id")
    got = selection.folds(df, "doc_id", 5, even).orderBy("doc_id").collect()
    assert [r["fold"] for r in got] == [k for k, n in enumerate(sizes) for _ in range(n)]


def test_selection_and_ranks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    rows = [(i, *map(float, v), 9 + int(round(3 * v[0])), i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, c double, grade int, fold int")
    assert selection.best(selection.f_scores(df, ["a", "b", "c"]), 1).first()["name"] == "a"
    chosen, score = selection.forward(df, ["a", "b"], kind="linear", patience=1)
    assert chosen[0] == "a" and score > 0.8
    assert selection.eliminate(df, ["a", "b", "c"], 1) == ["a"]
    assert selection.forest_importance(df, ["a", "b", "c"], 1, trees=5) == ["a"]
    ranks = selection.average_ranks(selection.ridge_weights(df, ["a", "b", "c"], 4))
    assert {r["rank"] for r in ranks.filter("name = 'a'").collect()} == {1.0}
    votes = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b")], "fold int, name string")
    assert [r["name"] for r in selection.votes(votes).collect()] == ["a"]
