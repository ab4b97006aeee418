import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import _words, quality
from tests.oracle import DATA


@pytest.fixture(scope="module")
def scored(spark):
    sf = f"{DATA}/sf0.01"
    rows = quality.op2_quality(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels


def test_every_document_once(spark, scored):
    rows, _ = scored
    assert len(rows) == spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == quality.is_held_out(r["doc_id"]) for r in rows)


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    ones, zeros = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert len(held) > 50 and auc >= 0.85
    assert np.mean([p == y for p, y, _ in held]) >= 0.8


def test_no_score_depends_on_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"good prose number {i}" if i % 2 else f"BUY BUY {i} !!!") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(i, i % 2 if not quality.is_held_out(i) else 1 - i % 2) for i in range(100)], "doc_id long, quality int")
    one, other = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "some words"), (5, "word " * 300000), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == 7 and all(r["score"] == 0.5 for r in out)
    empty = spark.createDataFrame([], docs.schema)
    assert quality.scored(empty, model).count() == 0
    assert quality.fit(empty, spark.createDataFrame([], labels.schema)).bias == 0
    extra = docs.selectExpr("doc_id", "text", "1 AS quality_score", "2 AS score")
    kept = quality.keep_good(extra, labels)
    assert kept.columns == extra.columns and kept.count() == 7


def test_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "Zé"], int(n))) for n in rng.integers(0, 60, 50)] + [None, ""]
    model = quality.Model(rng.normal(size=quality.N_BUCKETS).astype(np.float32), 0.1)
    whole = model.scores(pa.array(texts))
    assert np.allclose(whole, [model.scores(pa.array([t], pa.string()))[0] for t in texts])
    assert whole[-1] == whole[-2] == pytest.approx(1 / (1 + np.exp(-0.1)))


def plain_features(text):
    """Buckets of a text with repeats, word by word in whole numbers."""
    out, last = [], None
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        h = sum(int(_words._BYTE[b]) * pow(int(_words._STEP), i + 1, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
        h = (h ^ h >> 31) * int(_words._MIX) % (1 << 64)
        out.append((h ^ h >> 29) >> 64 - quality.BITS)
        if word == last:
            out.append(2 << quality.BITS)
        last, own = word, b"<" + word + b">"
        for n in quality.GRAMS:
            for i in range(len(own) - n + 1):
                h = 0
                for b in own[i : i + n]:
                    h = (h * 0x01000193 + (int(_words._BYTE[b]) >> 32 | 1)) % (1 << 32)
                h = (h + n) * 0x9E3779B1 % (1 << 32)
                h = (h ^ h >> 15) * 0x85EBCA6B % (1 << 32)
                out.append((h >> 32 - quality.BITS) + (1 << quality.BITS))
    return out


def plain_train(rows, epochs, dim, rate, seed):
    """Gradient descent with a dict of vectors, number by number."""
    rng = np.random.default_rng(seed)
    start = (rng.random((quality.N_BUCKETS, dim), dtype=np.float32) - np.float32(0.5)) / dim
    vectors = {b: [float(x) for x in start[b]] for bucket, *_ in rows for b in bucket.tolist()}
    out, bias, done = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, count, y = rows[i]
            lr = rate * (1 - done / (epochs * len(rows)))
            done += 1
            share = {b: n / count.sum() for b, n in zip(bucket.tolist(), count.tolist(), strict=True)}
            hidden = [sum(s * vectors[b][d] for b, s in share.items()) for d in range(dim)]
            logit = [sum(hidden[d] * out[d][k] for d in range(dim)) + bias[k] for k in (0, 1)]
            p = [1 / (1 + np.exp(logit[1 - k] - logit[k])) - (k == y) for k in (0, 1)]
            grad = [out[d][0] * p[0] + out[d][1] * p[1] for d in range(dim)]
            for k in (0, 1):
                bias[k] -= lr * p[k]
                for d in range(dim):
                    out[d][k] -= lr * hidden[d] * p[k]
            for b, s in share.items():
                vectors[b] = [v - lr * min(1, 50 * s) * g for v, g in zip(vectors[b], grad, strict=True)]
    return {b: sum(v[d] * (out[d][1] - out[d][0]) for d in range(dim)) for b, v in vectors.items()}, bias[1] - bias[0]


TEXTS = ["a fine and useful text about rivers", "BUY BUY now!!! cheap cheap", "", None, "one", "é ü 漢字 words", "more plain prose on rivers and hills", "WIN WIN cash now"]


def test_features_scores_and_training_equal_plain_ones():
    found = quality.sparse(pa.array(TEXTS))
    for t, (bucket, n) in zip(TEXTS, found, strict=True):
        assert Counter(plain_features(t)) == dict(zip(bucket.tolist(), n.tolist(), strict=True))
    rows = [(*f, int(i % 2)) for i, f in enumerate(found) if len(f[0])]
    model = quality.train(rows, epochs=3, dim=4, rate=0.5, seed=7)
    weights, bias = plain_train(rows, 3, 4, 0.5, 7)
    assert bias == pytest.approx(model.bias, abs=1e-5)
    assert all(w == pytest.approx(model.weights[b], abs=1e-5) for b, w in weights.items())
    own = model.scores(pa.array(TEXTS))
    for t, s in zip(TEXTS, own, strict=True):
        f = plain_features(t)
        assert s == pytest.approx(1 / (1 + np.exp(-(sum(float(model.weights[b]) for b in f) / max(len(f), 1) + model.bias))), abs=1e-9)


def test_training_takes_whole_texts_with_bounded_features(spark):
    bucket, n = np.arange(50000), np.ones(50000, np.int64)
    some, counts = quality.bounded((bucket, n), 1000)
    assert len(some) == len(counts) == 1000 and abs(some.mean() - 25000) < 2500
    long = " ".join(f"word{i}" for i in range(40000))
    docs = spark.createDataFrame([(i, long if i % 2 else "short one") for i in range(1, 9)] + [(1, "again")] * 30, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int"), rows=20)
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs.filter("text <> 'again'"), model).collect()}
    assert scores[3] > scores[2]


def test_training_is_not_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(quality, "train", lambda rows: quality.Model(np.zeros(quality.N_BUCKETS, np.float32), float(os.getpid())))
    docs = spark.createDataFrame([(i, f"words number {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality.fit(docs, labels).bias not in (0, os.getpid())
