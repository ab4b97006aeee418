"""Coherence: spatial statistics of a document's sliding word windows.

A document becomes windows of words a quarter of the corpus' mean length wide,
ten words apart (both halved while the document is no longer than the window).
Its windows, as TF-IDF vectors fitted on that document alone, are points; the
measures describe how they move and cluster.

Neighbour, centroid and autocorrelation measures are DataFrame aggregates in
long form.  Those over all pairs of a document's windows and the determinant
need its distance matrix, which :func:`coherence` builds in numpy, a document
at a time, next to the data: no shuffle.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

SHARE, STEP = 0.25, 10
#: Distances closer than this count as equal where a measure compares them.
SAME = 1e-6

NAMES = (
    *[f"{k}DistanceNeighbouringPoints{m}" for m in ("Euc", "Cos") for k in ("avg", "min", "max", "index")],
    *[f"{k}DistanceAnyPoints{m}" for m in ("Euc", "Cos") for k in ("avg", "max")],
    "clarkEvansNearestNeighbour", "avgDistanceNearestNeighbour", "cumulativeFrequencyDistribution",
    *[f"{k}DistanceCentroid{m}" for m in ("Euc", "Cos") for k in ("avg", "min", "max", "index")],
    "standardDistance", "relativeDistance", "determinantDistanceMatrix", "moransI", "gearysC", "getissG",
)


def content_words(text: Column, stopwords: list[str] | None = None) -> Column:
    return F.filter(T.words(T.tokens(text)), lambda t: ~T.listed(t, stopwords or T.STOPWORDS))


def window_size(words: DataFrame) -> DataFrame:
    """One row, column w0: a quarter of the mean number of words."""
    return words.agg(F.coalesce(F.floor(F.avg(F.size("words")) * SHARE), F.lit(0)).cast("int").alias("w0"))


def windows(words: DataFrame, size: DataFrame) -> DataFrame:
    """(doc_id, win, part) of (doc_id, words): window k is the words from k * step on; blank ones go, none left gives ``["0"]``."""
    # Halving while the document is no longer than the window; at most 31 times.
    start = F.struct(F.col("w0").alias("w"), F.lit(STEP).alias("step"))

    def halve(acc: Column, _: Column) -> Column:
        more = (F.col("n") <= acc["w"]) & (acc["w"] > 0)
        return F.when(more, F.struct(F.floor(acc["w"] / 2).cast("int").alias("w"), F.greatest(F.lit(1), F.floor(acc["step"] / 2)).cast("int").alias("step"))).otherwise(acc)

    sized = words.crossJoin(F.broadcast(size)).withColumn("n", F.size("words"))  # one row
    fit = sized.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve))
    w, step = F.col("fit.w"), F.col("fit.step")
    last = F.floor((F.col("n") - w) / step).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice("words", k * step + 1, w))
    two = lambda p: F.coalesce(F.length(F.get(p, F.lit(0))), F.lit(0)) + F.coalesce(F.length(F.get(p, F.lit(1))), F.lit(0)) > 1
    full = F.filter(cut, lambda p: two(p) | (F.length(F.array_join(p, "")) > 1))
    parts = F.when((F.col("n") > 0) & (F.size(full) > 0), full).otherwise(F.array(F.array(F.lit("0"))))
    return fit.select("doc_id", F.posexplode(parts).alias("win", "part"))


def window_vectors(parts: DataFrame) -> DataFrame:
    """(doc_id, win, term, w): TF-IDF fitted on each document's windows, rows of length 1; words of two characters or more."""
    long = parts.select("doc_id", "win", F.explode(F.filter("part", lambda t: t.rlike("^[\\p{L}\\p{N}_]{2,}$"))).alias("term"))
    counts = long.groupBy("doc_id", "win", "term").agg(F.count(F.lit(1)).alias("n"))
    total = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("N"))
    df = counts.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df")).join(total, "doc_id")
    idf = df.select("doc_id", "term", (F.ln((1.0 + F.col("N")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, ["doc_id", "term"]).select("doc_id", "win", "term", (F.col("n") * F.col("idf")).alias("r"))
    norm = raw.groupBy("doc_id", "win").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return raw.join(norm, ["doc_id", "win"]).select("doc_id", "win", "term", (F.col("r") / F.col("norm")).alias("w"))


def neighbour_distances(parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, win, euclidean, cosine) from window ``win`` to the next; cosine of an empty window is 0."""
    after = vectors.select("doc_id", (F.col("win") - 1).alias("win"), "term", F.col("w").alias("v"))
    dots = vectors.join(after, ["doc_id", "win", "term"]).groupBy("doc_id", "win").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    filled = vectors.select("doc_id", "win").distinct().withColumn("has", F.lit(1))
    order = Window.partitionBy("doc_id").orderBy("win")
    steps = parts.select("doc_id", "win").join(filled, ["doc_id", "win"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
    steps = steps.withColumn("next", F.lead("has").over(order)).filter("next is not null")
    joined = steps.join(dots, ["doc_id", "win"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
    euclid = F.sqrt(F.greatest(F.lit(0.0), F.col("has") + F.col("next") - 2 * F.col("dot")))
    both = (F.col("has") == 1) & (F.col("next") == 1)
    return joined.select("doc_id", "win", euclid.alias("euclidean"), F.when(both, 1 - F.col("dot")).otherwise(F.lit(0.0)).alias("cosine"))


def neighbour_measures(distances: DataFrame, parts: DataFrame) -> DataFrame:
    ids = parts.select("doc_id").distinct()
    agg = distances.groupBy("doc_id").agg(*[f(c).alias(f"{n}DistanceNeighbouringPoints{m}") for c, m in (("euclidean", "Euc"), ("cosine", "Cos")) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    out = ids.join(agg, "doc_id", "left").na.fill(0.0)
    for m in ("Euc", "Cos"):
        top = F.col(f"maxDistanceNeighbouringPoints{m}")
        out = out.withColumn(f"indexDistanceNeighbouringPoints{m}", F.when(F.abs(top) > 1e-9, F.col(f"minDistanceNeighbouringPoints{m}") / top).otherwise(F.lit(0.0)))
    return out


def dispersion(parts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, n, standardDistance, moransI, gearysC): sums over terms, no pairs of windows.

    A component without spread adds 0; fewer than two windows give 0.
    """
    sizes = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    after = vectors.select("doc_id", (F.col("win") - 1).alias("win"), "term", F.col("w").alias("v"))
    cross = vectors.join(after, ["doc_id", "win", "term"]).groupBy("doc_id", "term").agg(F.sum(F.col("w") * F.col("v")).alias("xy"))
    ends = vectors.join(sizes, "doc_id").groupBy("doc_id", "term", "n").agg(
        F.sum("w").alias("x"), F.sum(F.col("w") * F.col("w")).alias("xx"),
        F.sum(F.when(F.col("win") == 0, F.col("w")).otherwise(0.0)).alias("first"),
        F.sum(F.when(F.col("win") == F.col("n") - 1, F.col("w")).otherwise(0.0)).alias("last"),
    )
    c = F.col("x") / F.col("n")
    rows = ends.join(cross, ["doc_id", "term"], "left").withColumn("xy", F.coalesce("xy", F.lit(0.0)))
    spread = F.col("xx") - F.col("n") * c * c
    # Sum of D_i D_(i+1) and of (x_i - x_(i+1))^2 over neighbours, from sums over all windows less the ends.
    moran = F.col("xy") - c * (2 * F.col("x") - F.col("first") - F.col("last")) + (F.col("n") - 1) * c * c
    geary = 2 * F.col("xx") - F.pow("first", F.lit(2)) - F.pow("last", F.lit(2)) - 2 * F.col("xy")
    part = lambda v: F.when(spread > 1e-12, 2 * v / spread).otherwise(0.0)
    sums = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum(spread).alias("spread"), F.sum(part(moran)).alias("m"), F.sum(part(geary)).alias("g"))
    s = 2.0 * (F.col("n") - 1)
    joined = sizes.join(sums, "doc_id", "left").na.fill(0.0).withColumn("s", s)
    return joined.select(
        "doc_id", "n", F.sqrt(F.greatest(F.lit(0.0), F.col("spread") / F.col("n"))).alias("standardDistance"),
        F.when((F.col("n") > 1) & (F.col("terms") > 0), F.try_divide(F.col("n") * F.col("m"), F.col("s") * F.col("terms"))).otherwise(0.0).alias("moransI"),
        F.when((F.col("n") > 1) & (F.col("terms") > 0), F.try_divide((F.col("n") - 1) * F.col("g"), 2 * F.col("s") * F.col("terms"))).otherwise(0.0).alias("gearysC"),
    )


# --- a document's matrix ------------------------------------------------------------------------


def statistics(x: np.ndarray, names: Collection[str] = NAMES) -> dict[str, float]:
    """The measures ``names`` of points ``x`` (windows by components); no matrix is made that none of them needs."""
    n, k = x.shape
    square = np.einsum("ij,ij->i", x, x)
    length = np.sqrt(square)
    out: dict[str, float] = {}
    wanted = lambda *parts: any(p in name for name in names for p in parts)

    def apart(dot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a * b
        return np.where(both > 0, 1 - dot / np.where(both > 0, both, 1), 0.0)

    def four(name: str, d: np.ndarray) -> None:
        low, high = (d.min(), d.max()) if len(d) else (0.0, 0.0)
        kind, measure = name.split("|")
        out[f"avg{kind}{measure}"] = float(d.mean()) if len(d) else 0.0
        out[f"min{kind}{measure}"], out[f"max{kind}{measure}"] = float(low), float(high)
        out[f"index{kind}{measure}"] = float(low / high) if high > 1e-9 else 0.0

    if wanted("NeighbouringPoints"):
        dot = np.einsum("ij,ij->i", x[:-1], x[1:])
        four("DistanceNeighbouringPoints|Euc", np.sqrt(np.maximum(0, square[:-1] + square[1:] - 2 * dot)))
        four("DistanceNeighbouringPoints|Cos", apart(dot, length[:-1], length[1:]))
    if wanted("AnyPoints", "NearestNeighbour", "nearestNeighbour", "cumulativeFrequency", "determinant", "getissG"):
        gram = x @ x.T
        euc = np.sqrt(np.maximum(0, square[:, None] + square - 2 * gram))
        np.fill_diagonal(euc, 0)
        pairs = max(1, n * (n - 1) // 2)
        out["avgDistanceAnyPointsEuc"], out["maxDistanceAnyPointsEuc"] = float(euc.sum() / 2 / pairs), float(euc.max())
        if wanted("AnyPointsCos"):
            cos = apart(gram, length[:, None], length)
            out["avgDistanceAnyPointsCos"], out["maxDistanceAnyPointsCos"] = float((cos.sum() - np.trace(cos)) / 2 / pairs), float(cos.max())
        if wanted("determinant"):
            out["determinantDistanceMatrix"] = float(np.linalg.det(euc))
        if wanted("getissG"):
            close = (euc <= out["avgDistanceAnyPointsEuc"] + SAME).astype(float)
            np.fill_diagonal(close, 0)
            top_sum = np.einsum("ij,ij->j", close @ x, x)
            all_sum = x.sum(axis=0) ** 2 - np.einsum("ij,ij->j", x, x)
            some = np.abs(all_sum) > 1e-12
            out["getissG"] = float(np.where(some, top_sum / np.where(some, all_sum, 1), 0).sum() / k) if n > 1 else 0.0
        if wanted("NearestNeighbour", "nearestNeighbour", "cumulativeFrequency"):
            np.fill_diagonal(euc, np.inf)
            near = euc.min(axis=1) if n > 1 else np.zeros(n)
            mean = float(near.mean())
            out["clarkEvansNearestNeighbour"] = 2 * np.sqrt(n) * mean if n > 1 else 0.0
            out["avgDistanceNearestNeighbour"] = mean
            out["cumulativeFrequencyDistribution"] = float((near <= mean + SAME).mean()) if n > 1 else 0.0
    if wanted("Centroid", "standardDistance", "relativeDistance", "moransI", "gearysC"):
        c = x.mean(axis=0)
        spread = x - c
        to_c = np.sqrt(np.einsum("ij,ij->i", spread, spread))
        if wanted("Centroid"):
            four("DistanceCentroid|Euc", to_c)
            four("DistanceCentroid|Cos", apart(x @ c, length, np.full(n, np.sqrt(c @ c))))
        variance = np.einsum("ij,ij->j", spread, spread)
        out["standardDistance"] = float(np.sqrt(variance.sum() / n))
        top = max(1.0, to_c.max()) if to_c[0] < SAME else to_c.max()
        out["relativeDistance"] = out["standardDistance"] / top if top > SAME else 0.0
        if wanted("moransI", "gearysC"):
            some = variance > 1e-12
            s = 2.0 * (n - 1)
            safe = np.where(some, variance, 1)
            moran = np.where(some, 2 * np.einsum("ij,ij->j", spread[:-1], spread[1:]) / safe, 0).sum()
            step = x[:-1] - x[1:]
            geary = np.where(some, 2 * np.einsum("ij,ij->j", step, step) / safe, 0).sum()
            out["moransI"] = float(n / s * moran / k) if n > 1 else 0.0
            out["gearysC"] = float((n - 1) / (2 * s) * geary / k) if n > 1 else 0.0
    return out


def vectorize(parts: list[list[str]]) -> np.ndarray:
    """TF-IDF rows of one document's windows; without terms, a zero matrix."""
    ids: dict[str, int] = {}
    n = len(parts)
    rows = [[ids.setdefault(t, len(ids)) for t in p if len(t) > 1 and (t.replace("_", "a").isalnum())] for p in parts]
    if not ids:
        return np.zeros((n, n))
    x = np.zeros((n, len(ids)))
    for i, r in enumerate(rows):
        np.add.at(x[i], r, 1)
    x *= np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 1
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def cut(words: list[str], size: int) -> list[list[str]]:
    """Windows of one document, as of :func:`windows`."""
    n, w, step = len(words), size, STEP
    while w > 0 and n <= w:
        w, step = w // 2, max(1, step // 2)
    if not n:
        return [["0"]]
    found = [words[k * step : k * step + w] for k in range((n - w) // step + 2)]
    return [p for p in found if len("".join(p)) > 1] or [["0"]]


def points(words: list[str], size: int) -> np.ndarray:
    """:func:`vectorize` of :func:`cut`, by positions: each word is looked at once, not once for each window it is in."""
    n, w, step = len(words), size, STEP
    while w > 0 and n <= w:
        w, step = w // 2, max(1, step // 2)
    starts = np.arange(0, ((n - w) // step + 2) * step, step) if n else np.zeros(0, int)
    chars = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, n))))
    starts = starts[chars[np.minimum(starts + w, n)] - chars[np.minimum(starts, n)] > 1]
    if not len(starts):
        return np.zeros((1, 1))
    terms = [t for t in dict.fromkeys(words) if len(t) > 1 and (t.isalnum() or t.replace("_", "a").isalnum())]
    ids = dict(zip(terms, range(len(terms)), strict=True))
    named = np.fromiter((ids.get(t, -1) for t in words), np.int64, n)
    at = starts[:, None] + np.arange(w)
    found = np.where(at < n, named[np.minimum(at, n - 1)], -1)
    rows, cols = np.nonzero(found >= 0)
    if not len(rows):
        return np.zeros((len(starts), len(starts)))
    cells = rows * len(ids) + found[rows, cols]
    x = np.bincount(cells, np.ones(len(cells)), len(starts) * len(ids)).reshape(len(starts), len(ids))
    df = np.count_nonzero(x, axis=0)
    if not df.all():  # words between windows
        x, df = x[:, df > 0], df[df > 0]
    x *= np.log((1 + len(starts)) / (1 + df)) + 1
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def _lines(words: DataFrame) -> DataFrame:
    """(doc_id, line): words hold no blanks, so one string takes them to Python."""
    return words.select("doc_id", F.array_join("words", "\n").alias("line"))


def coherence(docs: DataFrame, stopwords: list[str] | None = None, size: int | None = None, embed=None, names: Collection[str] = NAMES) -> DataFrame:
    """doc_id and the measures ``names``, all 29 by default; ``size`` fixes the window (as a stream needs), ``embed`` maps windows to points."""
    words = docs.select("doc_id", content_words(F.col("text"), stopwords).alias("words"))
    w0 = size if size is not None else window_size(words).first()["w0"]
    names = tuple(names)
    point = (lambda own: embed(cut(own, w0))) if embed else (lambda own: points(own, w0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [statistics(point(line.split("\n") if line else []), names) for line in f["line"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), **{n: [r[n] for r in rows] for n in names}})

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{n} double" for n in names)
    return _lines(words).mapInPandas(run, schema)


def vector_totals(words: DataFrame, size: DataFrame) -> DataFrame:
    """(doc_id, n_terms, n_weights, total) of the vectors of :func:`window_vectors`, next to the data; documents without terms give no row."""
    w0 = size.first()["w0"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, line in zip(f["doc_id"], f["line"], strict=True):
                x = points(line.split("\n") if line else [], w0)
                if x.any():
                    rows.append((doc, x.shape[1], np.count_nonzero(x), float(x.sum())))
            yield pd.DataFrame(rows, columns=["doc_id", "n_terms", "n_weights", "total"])

    return _lines(words).mapInPandas(run, f"doc_id {dict(words.dtypes)['doc_id']}, n_terms long, n_weights long, total double")
