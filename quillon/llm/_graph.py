"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SMALL, materialize, small


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes that no star has: with two edges down, or with edges both up and down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return tuple(nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(F.col("down") + F.col("up") > 1)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs); root is the component's least node.

    Each round is two aggregations and two joins on node ids, and cuts its
    lineage in shared storage; rounds grow with the logarithm of the longest
    path, and end once all components are stars.  Minima are pre-aggregated
    before the shuffle.  While edges are few, the minima are broadcast at once;
    else they are written before they are joined, and joined from files, where
    AQE can split a hub's rows.  So a hub's edges never have to meet in one task.
    """
    pair = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(pair, "edges")
    edges, unsettled = _state(now)
    while unsettled:
        # At most a minimum for each end of an edge.
        few = 2 * edges <= SMALL
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = F.broadcast(low) if few else small(materialize(low, "star-lows"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = least if few else materialize(least, "star-leasts")
        rest = large.join(F.broadcast(least) if few else small(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        edges, unsettled = _state(now)
    root = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(root)
