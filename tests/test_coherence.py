import numpy as np
import pytest

from quillon.operators import coherence as C

POINTS = np.array([[1, 1, 1], [0, 1, 2], [2, 2, 1], [3, 4, 2]], float)
EXPECTED = {
    "avgDistanceAnyPointsEuc": 2.618617447, "maxDistanceAnyPointsEuc": 4.242640687, "avgDistanceNearestNeighbour": 1.673032607,
    "clarkEvansNearestNeighbour": 6.692130430, "cumulativeFrequencyDistribution": 0.75, "standardDistance": 1.732050808,
    "relativeDistance": 0.679366220, "determinantDistanceMatrix": -83.049067526, "moransI": -0.192592593, "gearysC": 0.838888889,
    "getissG": 0.628260628, "minDistanceCentroidEuc": 0.707106781, "maxDistanceCentroidEuc": 2.549509757,
    "minDistanceNeighbouringPointsEuc": 1.414213562, "maxDistanceNeighbouringPointsEuc": 2.449489743,
}


@pytest.mark.parametrize("name", EXPECTED)
def test_worked_example(name):
    assert C.statistics(POINTS)[name] == pytest.approx(EXPECTED[name], abs=1e-8)


def test_names_and_order():
    assert tuple(C.NAMES) == tuple(n for n in C.NAMES) and len(C.NAMES) == 29
    assert set(C.statistics(POINTS)) == set(C.NAMES)


def test_one_window_and_no_terms():
    for x in (np.ones((1, 3)), np.zeros((1, 1)), np.zeros((3, 3))):
        out = C.statistics(x)
        assert all(np.isfinite(v) for v in out.values())
        assert out["moransI"] == out["gearysC"] == out["getissG"] == 0


def loop(words, w):
    """Windows by the rule itself: halve, then slide while the start allows."""
    n, step = len(words), 10
    while w > 0 and n <= w:
        w, step = w // 2, max(1, step // 2)
    out, at = [words[:w]], 0
    while at + w <= n:
        at += step
        out.append(words[at : at + w])
    return [p for p in out if len("".join(p)) > 1] or [["0"]]


@pytest.mark.parametrize("seed", range(60))
def test_windows(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(rng.integers(1, 90))]
    size = int(rng.integers(1, 60))
    assert C.cut(words, size) == loop(words, size)
    assert C.cut([], size) == [["0"]]


def test_both_forms_agree(spark):
    """The long form and the matrix of a document give the same measures."""
    texts = ["apples grow on green trees near red barns while birds sing sweet songs " * k for k in (1, 3, 9)] + ["", None, "the of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    words = docs.select("doc_id", C.content_words(F.coalesce("text", F.lit(""))).alias("words"))
    parts = C.windows(words, C.window_size(words))
    long = {r["doc_id"]: r for r in C.dispersion(parts, C.window_vectors(parts)).collect()}
    near = {r["doc_id"]: r for r in C.neighbour_measures(C.neighbour_distances(parts, C.window_vectors(parts)), parts).collect()}
    for row in C.coherence(docs).collect():
        for n in ("standardDistance", "moransI", "gearysC"):
            assert row[n] == pytest.approx(long[row["doc_id"]][n], abs=1e-6)
        for n in ("avgDistanceNeighbouringPointsEuc", "maxDistanceNeighbouringPointsCos"):
            assert row[n] == pytest.approx(near[row["doc_id"]][n], abs=1e-6)
