import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import lines as L
from tests.llm import brute

LETTERS = list("abcdefgh")


def report(rows):
    """[line numbers dropped] of each row, by all pairs of lines; rows go by id and MD5 of the text, equal ones in any order."""
    key = lambda r: (rows[r][0] is None, rows[r][0] or 0, hashlib.md5((rows[r][1] or "").encode()).hexdigest())
    found = []
    for r, (_, text) in enumerate(rows):
        for pos, raw in enumerate((text or "").split("\n")):
            if raw.strip(" "):
                found.append(((key(r), r, pos), raw.strip(" ")))
    forest = brute.Forest()
    texts = sorted({t for _, t in found})
    for k, x in enumerate(texts):
        forest.find(x)
        for y in texts[:k]:
            if min(len(x), len(y)) >= L.LEAST_CHARS and abs(len(x) - len(y)) <= 1 and brute.edits(x, y) <= 1:
                forest.join(x, y)
    seen, out = set(), [[] for _ in rows]
    for (_, r, pos), t in sorted(found):
        if forest.find(t) in seen:
            out[r].append(pos)
        seen.add(forest.find(t))
    return out


def expected(rows):
    """(id, lines dropped), and (id, text left) of all rows."""
    drops = report(rows)
    texts = [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in d) for (_, t), d in zip(rows, drops, strict=True)]
    order = lambda x: sorted(x, key=str)
    return order((i, d) for (i, _), d in zip(rows, drops, strict=True)), order((i, t) for (i, _), t in zip(rows, texts, strict=True))


def measured(docs):
    order = lambda x: sorted(x, key=str)
    return order((r["doc_id"], list(r["dropped"])) for r in L.dedup_report(docs).collect()), order((r["doc_id"], r["text"]) for r in L.dedup(docs).collect())


def corpus(seed, n, length):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(LETTERS, int(rng.integers(*length)))) for _ in range(12)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(int(rng.integers(1, 5))):
            t = list(base[int(rng.integers(12))])
            for _ in range(int(rng.integers(0, 3))):
                at, kind = int(rng.integers(len(t))), int(rng.integers(3))
                t[at : at + (kind != 0)] = [] if kind == 1 else [str(rng.choice(LETTERS))]
            own.append(" " * int(rng.integers(2)) + "".join(t))
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize(("seed", "length", "bucket"), [(1, (15, 40), 32), (2, (20, 22), 2)])
def test_equals_all_pairs(spark, monkeypatch, seed, length, bucket):
    """Also with buckets so small that nearly all of them are split to the end."""
    monkeypatch.setattr(L.candidates, "__defaults__", (bucket,))
    rows = corpus(seed, 60, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], list(r["dropped"])) for r in L.dedup_report(docs).collect()), key=str)
    assert got == expected(rows)[0]
    assert any(d for _, d in got)


def test_repeated_and_null_ids_lose_no_text(spark):
    line = "a line that several rows repeat"
    rows = [(1, line + "\nfirst"), (2, line + "\nother"), (2, "a wholly unique sentence of its own\nother text"), (None, line), (None, "unique text held by one row only"), (None, line)]
    rows += [(3, "x\n\ny"), (3, "x\n\ny"), (3, "x\n\ny"), (3, None), (3, ""), (4, line), (4, line + "\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "__dropped", "dropped", "uid", "G_ID", "c_id", "first")})
    assert measured(docs) == expected(rows)
    assert L.dedup(docs).columns == docs.columns


def test_lines_that_share_a_hash(spark, monkeypatch):
    """With a hash of 200 values many lines share one; none is taken for another."""
    monkeypatch.setattr(L, "_hash", lambda line, attempt=0: F.pmod(F.xxhash64(F.lit(attempt), line), F.lit(200)))
    rows = [(None if i % 5 == 0 else i % 4, t) for i, t in corpus(6, 30, (15, 24))]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines, moved = L.numbered(docs)
    assert moved is not None and lines.select("id").distinct().count() == lines.count()
    assert measured(docs) == expected(rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=1, max_size=40))
def test_bit_parallel_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "x string, y string")
    for tau in (1, 2):
        got = [r[0] for r in df.select(L.within(F.col("x"), F.col("y"), tau)).collect()]
        assert got == [brute.edits(x, y) <= tau for x, y in pairs]


def test_defined_cases(spark):
    line = "this line is long enough to count"
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, f"{line}\n{line}\nshort\nshort"), (None, line + "s"), (5, f"other\n{line}"), (5, "other"), (6, "x" * 20000 + "\n" + "x" * 20001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "pos": F.lit(2)})
    assert sorted(r["n_lines"] for r in L.dedup_report(docs).collect()) == [0, 0, 0, 1, 1, 2, 2, 4]
    kept = L.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in kept.filter("doc_id <> 5").collect()}
    assert texts[4] == f"{line}\nshort" and texts[1] is None and texts[3] == " \n \n"
    assert L.dedup_report(spark.createDataFrame([], docs.schema)).count() == 0
