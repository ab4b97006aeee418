"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, without case.  Every run of ``SEED``
words of a test item is a seed, and all of them join documents to items: an
edited copy may hold any part of them, so none is left out for being frequent
or rare.  The words around each hit are aligned with the item by local
alignment (match 2, mismatch -1, gap -1), and pairs whose score is at least
``THRESHOLD`` of a verbatim copy's are kept.  A window goes without alignment
only if it has too few words of the item for such a score.  What no seed
reaches is a copy that keeps no ``SEED`` words of the item in a row.

Texts never shuffle.  Items come in waves of at most ``WAVE_BYTES`` of
text (one item at least), so the seeds that are broadcast have a bound however
many items there are; each wave is a pass over the documents.

Defined cases: a null, empty or very short document has no leak.  Items
without text or of fewer than ``LEAST_WORDS`` words match nothing.  Repeated
items are items of their own.  A document row with several copies of an item
gives one row, for the best.  Repeated document rows are judged one by one.
Empty tables give empty results; extra columns are kept by :func:`remove` and
ignored by :func:`leaks`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import materialize, table

SEED = 3
#: Items of fewer words are found verbatim only.
SHORT = 8
THRESHOLD = 0.5
WAVE_BYTES = 1 << 24
MATCH, MISMATCH, GAP = 2, 1, 1

#: Anything in ASCII but letters and digits parts words.
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capitals of U+00C0..U+00DE."""
    out = _FOLD[raw]
    if len(out) > 1:
        wide = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][wide] += 0x20
    return out


def _hashed(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every word."""
    raw = fold(raw)
    start, end, row = _words.bounds(offsets, raw, _APART)
    return _words.hashes(raw, start, end), row


def _overlapping(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Pieces as of :func:`_words.pieces`, with the number of words before them; those of one long text share ``overlap`` bytes or a little more."""
    last, tail, done, shared = -1, np.empty(0, np.uint8), 0, 0
    for rows, offsets, raw in _words.pieces(column):
        if len(rows) == 1 and rows[0] == last:
            raw = np.concatenate([tail, raw])
            offsets = np.array([0, len(raw)])
        else:
            done = shared = 0
        last = int(rows[-1])
        yield rows, offsets, raw, done - shared
        if len(rows) == 1:
            tail = raw[max(0, len(raw) - overlap) :]
            cut = np.flatnonzero(_APART[tail]) if len(tail) < len(raw) else np.zeros(1, np.int64)
            tail = tail[int(cut[0]) :] if len(cut) else tail
            count = lambda x: len(_words.bounds(np.array([0, len(x)]), x, _APART)[0])
            done, shared = done - shared + count(raw), count(tail)


@dataclass
class Items:
    """Test items of a wave, by number 0, 1, ...; seeds sorted by hash."""

    ids: list[int | None]
    words: list[np.ndarray]
    reach: int = 0
    seed: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted, repeats kept
    item: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    filter: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))  # by the first bits of a seed
    sizes: tuple[int, ...] = ()  # numbers of words of the seeds there are

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], least: int = 1) -> Items:
        ids, words, seeds = [], [], []
        reach = 0
        for item_id, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            h, row = _hashed(np.array([0, len(raw)]), raw)
            if len(h) < max(1, least):
                continue
            grams, at = _words.chained(h, row, min(SEED, len(h)))
            seeds.append((grams, np.full(len(at), len(ids), np.int32), at.astype(np.int32)))
            ids.append(item_id)
            words.append(h)
            reach = max(reach, 3 * len(raw))
        out = cls(ids, words, reach, sizes=tuple(sorted({min(SEED, len(w)) for w in words})))
        if seeds:
            out._set(*(np.concatenate(x) for x in zip(*seeds, strict=True)))
        return out

    def _set(self, seed: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.filter = np.zeros(1 << min(25, max(20, (8 * len(seed)).bit_length())), bool)
        self.filter[self._cells(self.seed)] = True

    def _cells(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(65 - len(self.filter).bit_length())).astype(np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into grams, first index into seeds) where a gram is a seed."""
        some = np.flatnonzero(self.filter[self._cells(grams)])
        at = np.searchsorted(self.seed, grams[some], "left")
        ok = at < len(self.seed)
        ok[ok] = self.seed[at[ok]] == grams[some[ok]]
        return some[ok], at[ok]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score against each row of ``windows`` (0 pads), and the column where it ends."""
    n, width = windows.shape
    slope = GAP * np.arange(width, dtype=np.int32)
    row = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for word in item:
        diagonal = np.zeros((n, width), np.int32)
        diagonal[:, 1:] = row[:, :-1]
        x = np.maximum(np.maximum(diagonal + np.where(windows == word, MATCH, -MISMATCH).astype(np.int32), row - GAP), 0)
        row = np.maximum.accumulate(x + slope, axis=1) - slope  # a run of gaps in the item's favour
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _may_score(item: np.ndarray, windows: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``windows`` have enough words of ``item``: a score is at most that of its matches, and each takes a word."""
    own = np.unique(item)
    at = np.minimum(np.searchsorted(own, windows), len(own) - 1)
    return (own[at] == windows).sum(axis=1) >= threshold * len(item)


def _found(items: Items, column: pa.Array, threshold: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """{(row, item): (score, first word, end word)} of a batch."""
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for rows, offsets, raw, before in _overlapping(column, items.reach):
        h, text = _hashed(offsets, raw)
        # A seed's hash depends on its number of words, so those of all sizes are looked up together.
        parts = [_words.chained(h, text, n) for n in items.sizes]
        grams, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        gi, first = items.hits(grams)
        if not len(gi):
            continue
        count = np.searchsorted(items.seed, grams[gi], "right") - first
        spread = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        item, offset = items.item[spread], np.repeat(at[gi], count) - items.place[spread]
        of = text[np.repeat(at[gi], count)]
        sizes = np.array([len(w) for w in items.words])
        zone = offset // np.maximum(4, sizes[item] // 2)
        key = np.stack([item, of, zone])
        order = np.lexsort((offset, *key[::-1]))
        key, offset = key[:, order], offset[order]
        new = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        last = np.r_[new[1:], len(offset)] - 1
        low, high = np.searchsorted(text, np.arange(len(rows)), "left"), np.searchsorted(text, np.arange(len(rows)), "right")
        item, of, zone = key[:, new]
        for k in np.unique(item).tolist():
            own = np.flatnonzero(item == k)
            m = int(sizes[k])
            least = threshold if m >= SHORT else 1.0
            spare = max(0, math.ceil(2 * m * (1 - least)))  # most words that a copy may have too many
            step = max(1, min(256, (1 << 20) // m))
            for cut in range(0, len(own), step):
                part = own[cut : cut + step]
                begin = np.maximum(low[of[part]], offset[new[part]] - spare)
                stop = np.minimum(high[of[part]], offset[last[part]] + m + spare)
                width = int((stop - begin).max())
                where = begin[:, None] + np.arange(width)
                inside = where < stop[:, None]
                windows = np.where(inside, h[np.minimum(where, len(h) - 1)], np.uint64(0))
                likely = _may_score(items.words[k], windows, least)
                if not likely.any():
                    continue
                part, begin, windows = part[likely], begin[likely], windows[likely]
                best, end = align(items.words[k], windows)
                good = np.flatnonzero(best >= least * MATCH * m)
                if not len(good):
                    continue
                _, back = align(items.words[k][::-1], windows[good][:, ::-1])
                for g, tail in zip(good.tolist(), back.tolist(), strict=True):
                    r = int(of[part[g]])
                    here = before + int(begin[g] - low[r])
                    value = (float(best[g]) / (MATCH * m), here + width - 1 - tail, here + int(end[g]) + 1)
                    pair = (int(rows[r]), k)
                    out[pair] = max(out.get(pair, (0.0, 0, 0)), value)
    return out


def _waves(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, wave) and the number of waves."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    waves = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WAVE_BYTES))
    return rows.withColumn("wave", F.pmod(F.xxhash64("item_id", "text"), F.lit(waves))), waves


def _seeded(benchmark: DataFrame, least: int = 1) -> Iterator[Items]:
    """Items of each wave with all their seeds; those of fewer than ``least`` words are left out."""
    rows, waves = _waves(benchmark)
    for w in range(waves):
        own = rows.filter(F.col("wave") == w).drop("wave").toArrow()
        items = Items.of(sorted(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1])), least)
        if items.ids:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (1: verbatim), first_word, end_word: a row for each document row and item aligned."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.col("text").cast("string"))
    schema = slim.select("doc_id").schema.add("item_id", "long").add("score", "double").add("first_word", "long").add("end_word", "long")
    out = spark.createDataFrame([], schema)
    for items in _seeded(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for b in batches:
                got = _found(held, b.column(1), threshold)
                if got:
                    keys = sorted(got)
                    cols = [b.column(0).take(pa.array([r for r, _ in keys])), pa.array([held.ids[k] for _, k in keys], pa.int64())]
                    values = [pa.array([got[k][i] for k in keys], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*cols, *values], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        out = out.unionByName(materialize(slim.mapInArrow(run, schema), "leaks"))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that align with no item of ``SEED`` or more words; a filter in place, row by row."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for items in _seeded(benchmark, SEED):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = np.ones(b.num_rows, bool)
                good[[r for r, _ in _found(sent.value, b.column(at), threshold)]] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
