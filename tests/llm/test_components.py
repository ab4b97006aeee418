import numpy as np
import pytest

from quillon.llm import _graph
from quillon.llm._common import scope
from tests.llm import brute


def found(spark, edges):
    with scope() as made:
        got = _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r["node"] for r in got}) == len(got)
    return {r["node"]: r["root"] for r in got}, len(made)


def truth(edges):
    forest = brute.Forest()
    for a, b in edges:
        forest.join(a, b)
    return {x: forest.find(x) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("few", [True, False])
def test_components_of_odd_graphs(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(_graph, "SMALL", 0)
    rng = np.random.default_rng(4)
    graphs = [
        [tuple(e) for e in rng.integers(-50, 50, (60, 2)).tolist()],
        [(x, x + 1) for x in range(70)],
        [(500, x) for x in range(0, 900, 3)] + [(7, 7), (-(2**63), 2**63 - 1), (2**63 - 1, 1)],
    ]
    for edges in graphs:
        assert found(spark, edges)[0] == truth(edges)


def test_rounds_end_with_stars(spark):
    """Every table written is a job of a task for each partition, and more for the driver to hold."""
    assert found(spark, [])[1] == found(spark, [(1, x) for x in range(2, 40)])[1] == 1
    assert found(spark, [(x, x + 1) for x in range(16)])[1] <= 9
