import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann


def brute(rows, queries, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in queries:
        if q not in good:
            continue
        scores = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                a, b = good[q], v
                scores.append((-float(np.cumsum(a * b)[-1] / (np.sqrt(np.cumsum(a * a)[-1]) * np.sqrt(np.cumsum(b * b)[-1]))), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "wave", "dim"), [(0, 1 << 15, 16), (1, 3, 8), (2, 1 << 15, 1500)])
def test_equals_brute_force(spark, seed, wave, dim):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [(400, [0.0] * dim), (450, None), (500, [None] + [1.0] * (dim - 1)), (550, [float("nan")] * dim), (600, [float("inf")] + [1.0] * (dim - 1)), (650, []), (700, [1.0, 2.0]), (750, [2.0, 4.0]), (800, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "is_query": F.lit("x")})
    got = ann.search(df, F.col("vec_id") % 50 == 0, wave=wave)
    own = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())
    assert own == brute(rows, [i for i, _ in rows if i % 50 == 0], 5)


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    assert ann.search(spark.createDataFrame([], df.schema), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1.0), (0, 2, 0.0)]  # the least vector of each id: [0, 1] and [0, 2]


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, c = ann._Block(np.arange(40), rng.normal(size=(40, 24))), ann._Block(np.arange(90), rng.standard_t(2, size=(90, 24)))
    near = ann._products(q.codes, c.codes) * (q.scale[:, None] * c.scale)
    miss = q.kept[:, None] * c.lost + q.lost[:, None] + ann.SLACK
    true = (q.vectors / q.norm[:, None]) @ (c.vectors / c.norm[:, None]).T
    assert (np.abs(true - near) <= miss).all()
