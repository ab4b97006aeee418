import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing as M
from tests.llm.brute import WORD


def goals(sizes):
    """Targets by repeated sharing: whoever is above 3 times its size stops there."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def mixture(rows):
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    target = goals(sizes)
    out = []
    for s, total in sizes.items():
        budget = int(np.floor(target[s] + 1e-9 if abs(target[s] - round(target[s])) < 1e-9 else target[s]))
        epochs = budget // total if total else 0
        rest = budget - epochs * total
        for i, _, n in sorted((x for x in sized if x[1] == s), key=lambda x: (hashlib.md5(f"mix:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[2])):
            part = min(n, max(0, rest))
            rest -= part
            out.append((i if i is not None else -1, n, total, round(target[s], 6), epochs * n + part))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_equals_exact_prefix_sums(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["b", "a", "é", "zz", "hot", None, "tiny"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), names[min(6, int(rng.exponential(2)))]) for i in range(300)]
    rows += [(1000 + i, "one two", "hot") for i in range(200)] + [(5, "x y", "a"), (None, "n n n", "a"), (2000, None, "void"), (2001, "", None), (2002, "é\tü\nß", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "bucket": F.lit(2), "key": F.lit(3)})
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in M.mix_table(docs).collect())
    assert got == mixture(rows)
    assert all(r[4] <= 3 * r[1] for r in got)
    words = sum(r[4] for r in got)
    assert abs(words - sum(r[1] for r in got)) <= len(names) + 1


def test_one_id_on_a_third_of_all_rows(spark):
    """The cut of its source falls among rows that can't be told apart."""
    rows = [(5, "a b c", "a")] * 300 + [(None, "x y", "b")] * 200 + [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(400, 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in M.mix_table(docs).collect())
    assert got == mixture(rows)
    assert len({r[4] for r in got if r[0] == 5}) > 1
    words = {}
    for r in M.mix(docs).collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    target = {r["source"]: r["target"] for r in M.mix_table(docs).select("source", "target").distinct().collect()}
    assert all(abs(words[s] - t) <= 0.1 * t for s, t in target.items())


def test_mixed_corpus_follows_the_plan(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 20))), "abc"[min(2, i // 150)]) for i in range(400)] + [(500, None, "a"), (501, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m_key", F.lit("k"))
    out = M.mix(docs)
    assert out.columns == docs.columns
    words = {}
    copies = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    target = {r["source"]: r["target"] for r in M.mix_table(docs).select("source", "target").distinct().collect()}
    assert all(abs(words.get(s, 0) - t) <= 20 for s, t in target.items())
    assert copies[500] >= 1 and copies[501] == 1


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_table(docs).count() == M.mix(docs).count() == 0
    void = spark.createDataFrame([(1, None, "a"), (2, " ", None)], docs.schema)
    assert [(r["target"], r["taken"]) for r in M.mix_table(void).collect()] == [(0.0, 0), (0.0, 0)]
    assert M.mix(void).count() == 2


def test_reruns_agree(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i % 3 else "t") for i in range(200)], "doc_id long, text string, source string")
    one, other = M.mix_table(docs.repartition(7)).collect(), M.mix_table(docs.repartition(3)).collect()
    assert sorted(one) == sorted(other)
