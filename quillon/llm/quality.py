"""Quality classifier: supervised subword embeddings.

A text's features are its words and their byte n-grams (3 to 5 bytes of the
word between ``<`` and ``>``; case is kept, as it tells shouting from prose),
hashed into ``2**BITS`` buckets each for words and n-grams.  A word equal to
the one before it adds one feature more, the same for all words.  A text is the mean
of its features' vectors; a softmax over two classes follows.  Vectors and
softmax are trained together by stochastic gradient descent in numpy.

Scoring needs one number a bucket: as the mean and the difference of the two
logits are linear, vector and softmax fold into a weight for each bucket.  So
texts are scored by table lookups on whole Arrow batches, and the broadcast
is about 2**(BITS + 1) float32 whatever the input.

Training takes at most ``TRAIN_ROWS`` labelled rows, the first in the order of
a hash of their id, with their whole texts; of a text with more than
``TRAIN_FEATURES`` different features it takes those first in the order of a
hash, which bounds what the task that trains holds.  Scoring covers all rows and whole
texts with all their features.

Defined cases: a null, empty or blank text has no features and gets the score
of the bias alone.  Rows with a null label teach nothing; repeated labels teach
repeatedly.  A null ``doc_id`` counts as the empty id.  Without labels of both
classes every score is the share of label 1 (0.5 without any).  Labels, lang,
source and doc_id never enter a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import _words
from ._common import table, unused

BITS = 18
#: Words, n-grams, and one for a word that repeats the word before it.
N_BUCKETS = (2 << BITS) + 1
GRAMS = (3, 4, 5)
DIM = 12
EPOCHS = 8
RATE = 0.5
TRAIN_ROWS = 2000
#: Most different features of a text that training takes.
TRAIN_FEATURES = 1 << 14
FOLDS = 5
THRESHOLD = 0.3

_BYTE32 = (_words._BYTE >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def features(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the text) of words, then of the n-grams of each length."""
    start, end, row = _words.bounds(offsets, raw)
    if not len(start):
        return
    h = _words.hashes(raw, start, end)
    yield (h >> np.uint64(64 - BITS)).astype(np.int64), row
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    yield np.full(len(again), 2 << BITS), row[again]
    data, at = _words.scatter_words(raw, start, end, 1)
    size = end - start + 2
    data[at], data[at + size - 1] = ord("<"), ord(">")
    left = np.repeat(at + size, size) - np.arange(len(data))
    rows = np.repeat(row, size)
    code = _BYTE32[data]
    with np.errstate(over="ignore"):
        h = code[:].copy()
        for n in range(2, max(GRAMS) + 1):
            if n > len(data):
                break
            h = h[: len(data) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
            if n in GRAMS:
                ok = left[: len(h)] >= n
                mixed = (h[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0x85EBCA6B)
                yield (mixed >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS), rows[: len(h)][ok]


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each bucket
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total, n = np.zeros(len(column)), np.zeros(len(column))
        for rows, offsets, raw in _words.pieces(column):
            for bucket, row in features(offsets, raw):
                at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
                if len(at):
                    which = rows[row[at]]
                    total[which] += np.add.reduceat(self.weights[bucket], at, dtype=np.float64)
                    n[which] += np.diff(np.r_[at, len(row)])
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def sparse(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of each text."""
    got: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for rows, offsets, raw in _words.pieces(column):
        for bucket, row in features(offsets, raw):
            cuts = np.flatnonzero(np.diff(row)) + 1
            for part, r in zip(np.split(bucket, cuts), row[np.r_[0, cuts]] if len(row) else [], strict=False):
                got[rows[r]].append(part)
    return [np.unique(np.concatenate(g), return_counts=True) if g else (np.empty(0, np.int64), np.empty(0, np.int64)) for g in got]


def bounded(found: tuple[np.ndarray, np.ndarray], most: int = TRAIN_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` features of a text that are first by a hash of their bucket."""
    bucket, n = found
    if len(bucket) <= most:
        return found
    with np.errstate(over="ignore"):
        mixed = (bucket.astype(np.uint64) + np.uint64(1)) * _words._STEP
        mixed = (mixed ^ mixed >> np.uint64(31)) * _words._MIX
    some = np.sort(np.argsort(mixed, kind="stable")[:most])
    return bucket[some], n[some]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, dim: int = DIM, rate: float = RATE, seed: int = 7) -> Model:
    """rows: (buckets, counts, label 0 or 1) of each text, in a fixed order."""
    rows = [r for r in rows if len(r[0])] or rows
    ones = sum(y for *_, y in rows)
    if not rows or ones in (0, len(rows)):
        share = min(max(ones / len(rows), 0.01), 0.99) if rows else 0.5
        return Model(np.zeros(N_BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = (rng.random((N_BUCKETS, dim), dtype=np.float32) - np.float32(0.5)) / dim
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps = epochs * len(rows)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, count, y = rows[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            share = (count / count.sum()).astype(np.float32)
            hidden = share @ vectors[bucket]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            grad = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p
            # Each feature gets the whole step, as in word-by-word training of averaged embeddings.
            vectors[bucket] -= lr * np.minimum(1, share * 50)[:, None] * grad
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y, text) of the documents of at most ``rows`` labels that are not held out.

    ``rows`` of labels are chosen first, so the join's small side has a bound.
    """
    order = F.xxhash64("doc_id")
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    some = known.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(order, "doc_id", "y").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Features are made on the executors; one task trains on the sparse rows of the bounded sample, and the driver receives the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bounded(f) for f in sparse(b.column(2))]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "y", "bucket", "n"])

    sample = labelled(docs, labels, label, rows)
    schema = sample.select("doc_id", "y").schema.add("bucket", ArrayType(IntegerType())).add("n", ArrayType(IntegerType()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(i, y, *(b.column(k)[at].values.to_numpy(False) for k in (2, 3))) for b in batches for at, (i, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))]
        got.sort(key=lambda r: (r[0], r[1], len(r[2])))
        model = train([(bucket, n, y) for _, y, bucket, n in got])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    # Where doc_ids repeat, the rows are more than the labels: the bound holds for them, too.
    some = sample.mapInArrow(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("bucket")).limit(rows)
    model = some.mapInArrow(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(model["weights"]), np.float32), model["bias"]) if model else train([])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score column; whole texts, in Arrow batches."""
    name = unused(docs, name)[0]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.scores(part.column(at)))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; only ids and scores leave Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1)))], names=["doc_id", "score"])

    slim = docs.select("doc_id", F.col("text").cast("string"))
    out = slim.mapInArrow(run, slim.select("doc_id").schema.add("score", "double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    out = score(docs, fit(docs, labels), "quality_score")
    return out.filter(F.col(out.columns[-1]) >= threshold).drop(out.columns[-1])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
