"""Nearest neighbours by a block matrix join on int8 products.

Vectors are scaled to length 1 and rounded to int8 with a scale of their own.
A tile of queries times a tile of candidates is one matrix product of the
rounded values (exact: integers below 2**24 in float32).  With the norms of
the rounding residuals, each product bounds the true cosine from both sides,
so a pair is dropped only if its upper bound is under the query's k-th best
lower bound.  The others are computed again in double precision on the
original vectors and merged by heaps: one of k entries for each query in a
task, then a top-k over tasks.

Queries are a stated set.  They are read in waves of at most ``WAVE`` rows,
each broadcast to a pass over all candidates, so what is broadcast has a bound
however many queries there are.  Candidates never shuffle.

Defined cases: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, nor do rows without an id.  Vectors of
unequal dimension are not compared.  Rows that share an id count as one, that
with the least vector.  With fewer than k candidates all are returned.  Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, table

K = 5
#: Most queries of a pass.
WAVE = 1 << 15
Q_TILE, C_TILE = 512, 2048
#: Rounding of the float32 bounds themselves.
SLACK = 1e-5


def _matrices(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors as float64 matrices by dimension."""
    if isinstance(vectors, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    known = ids.is_valid().to_numpy(False) & vectors.is_valid().to_numpy(False)
    size = vectors.value_lengths().fill_null(0).to_numpy(False)
    start = vectors.offsets.to_numpy(False)[:-1].astype(np.int64)
    values = vectors.values.cast(pa.float64())
    flat = np.asarray(values.fill_null(np.nan).to_numpy(False) if values.null_count else values.to_numpy(False))
    keys = np.asarray(ids.fill_null(0).to_numpy(False), np.int64)
    out = {}
    for dim in np.unique(size[known & (size > 0)]).tolist():
        at = np.flatnonzero(known & (size == dim))
        m = flat[start[at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.cumsum(m * m, axis=1)[:, -1])
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            out[dim] = (keys[at[good]], m[good])
    return out


class _Block:
    """Vectors of one dimension, rounded."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.norm = np.sqrt(np.cumsum(vectors * vectors, axis=1)[:, -1])
        unit = vectors / self.norm[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / scale[:, None]).astype(np.int8)
        near = self.codes * scale[:, None]
        self.scale = scale.astype(np.float32)
        self.lost = np.sqrt(((unit - near) ** 2).sum(axis=1)).astype(np.float32)
        self.kept = np.sqrt((near**2).sum(axis=1)).astype(np.float32)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of int8 rows; exact, as each slice of 1024 dimensions sums below 2**24."""
    out = np.zeros((len(q), len(c)), np.float32 if q.shape[1] <= 1024 else np.float64)
    for at in range(0, q.shape[1], 1024):
        out += q[:, at : at + 1024].astype(np.float32) @ c[:, at : at + 1024].astype(np.float32).T
    return out


def cosine(q: np.ndarray, qn: np.ndarray, c: np.ndarray, cn: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component to the last."""
    return np.cumsum(q * c, axis=1)[:, -1] / (qn * cn)


def _scan(queries: dict[int, _Block], batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
    floor = {d: np.full(len(b.ids), -np.inf, np.float32) for d, b in queries.items()}
    for batch in batches:
        for dim, (ids, m) in _matrices(batch.column(0), batch.column(1)).items():
            if dim not in queries:
                continue
            block, low = queries[dim], floor[dim]
            for lo in range(0, len(ids), C_TILE):
                c = _Block(ids[lo : lo + C_TILE], m[lo : lo + C_TILE])
                for at in range(0, len(block.ids), Q_TILE):
                    s = slice(at, at + Q_TILE)
                    near = _products(block.codes[s], c.codes) * (block.scale[s][:, None] * c.scale)
                    miss = block.kept[s][:, None] * c.lost + block.lost[s][:, None] + np.float32(SLACK)
                    own = block.ids[s][:, None] == c.ids
                    near[own] = -np.inf
                    if len(c.ids) >= k:
                        sure = np.partition(near - miss, len(c.ids) - k, axis=1)[:, len(c.ids) - k]
                        low[s] = np.maximum(low[s], sure)
                    qi, ci = np.nonzero((near + miss >= low[s][:, None]) & ~own)
                    for cut in range(0, len(qi), 1 << 16):
                        a, b = qi[cut : cut + (1 << 16)] + at, ci[cut : cut + (1 << 16)]
                        score = cosine(block.vectors[a], block.norm[a], c.vectors[b], c.norm[b])
                        for q, sc, v in zip(a.tolist(), score.tolist(), (-c.ids[b]).tolist(), strict=True):
                            heap = heaps.setdefault((dim, q), [])
                            if len(heap) < k:
                                heapq.heappush(heap, (sc, v))
                            else:
                                heapq.heappushpop(heap, (sc, v))
                                low[q] = max(low[q], np.float32(heap[0][0] - SLACK))
    rows = [(int(queries[d].ids[q]), -v, sc) for (d, q), heap in heaps.items() for sc, v in heap]
    if rows:
        a, b, s = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest others of every row that ``is_query`` marks.

    ``is_query`` refers to the id column.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
    repeated = base.groupBy("vec_id").count().filter("count > 1 and vec_id is not null").select("vec_id")
    repeated = materialize(repeated, "repeated-vectors")
    if repeated.take(1):
        usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        first = base.join(repeated, "vec_id", "left_semi").filter(usable).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
        base = base.join(repeated, "vec_id", "left_anti").unionByName(first)
    asked = materialize(base.filter("is_query and v is not null and vec_id is not null").select("vec_id", "v"), "queries")
    waves = max(1, -(-asked.count() // wave))
    found = None
    for w in range(waves):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).toArrow()
        held = {d: _Block(*x) for d, x in _matrices(rows.column(0), rows.column(1)).items()}
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _scan(sent.value, batches, k)

        part = base.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")
        if waves > 1:
            part = materialize(part, "neighbours")
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) / (q.n * c.n) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
