"""The pipeline against a plain version of each stage on the rows that the stage before it left."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, quality
from quillon.llm._common import materialize, table
from tests.llm import brute
from tests.llm.test_decontaminate import score
from tests.llm.test_mixing import mixture
from tests.llm.test_sharding import greedy
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, SF), f"test-{name}")
    return {k: (v.columns, v.collect()) for k, v in out.items()}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_columns(steps):
    base = steps["input"][0]
    assert [steps[n][0] for n, _ in corpus_pipeline.STAGES] == [base] * 4 + [[*base, "shard"]]


def test_quality(spark, steps):
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = steps["input"][1]
    kept = model.scores(pa.array([r["text"] for r in rows])) >= quality.THRESHOLD
    assert ids(steps["quality"][1]) == ids([r for r, k in zip(rows, kept, strict=True) if k])


def test_near_dedup(steps):
    """Groups of the true shingle sets, by all pairs."""
    rows = sorted(steps["quality"][1], key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        words = (r["text"] or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    forest = brute.Forest()
    for i, a in enumerate(sets):
        forest.find(i)
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                forest.join(i, j)
    assert ids(steps["near_dedup"][1]) == [r["doc_id"] for i, r in enumerate(rows) if forest.find(i) == i]
    assert len(steps["near_dedup"][1]) < len(rows)


def test_decontamination(spark, steps):
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    clean = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t).split())
    kept, gone = set(ids(steps["decontaminate"][1])), []
    for r in steps["near_dedup"][1]:
        if r["doc_id"] not in kept:
            gone.append(max(score(clean(i), clean(r["text"])) for i in items))
    assert all(g >= decontaminate.THRESHOLD for g in gone)
    left = [r for r in steps["near_dedup"][1] if r["doc_id"] in kept]
    assert all(clean(i).lower() not in clean(r["text"] or "").lower() for r in left for i in items)


def test_mixing(steps):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in steps["decontaminate"][1]]
    copies = {}
    for r in steps["mixing"][1]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for doc_id, size, *_, taken in mixture(rows):
        if size:
            assert copies.get(doc_id, 0) in (taken // size, -(-taken // size))


def test_sharding(spark, steps):
    rows = steps["sharding"][1]
    assert ids(rows) == ids(steps["mixing"][1])
    from quillon.llm import sharding

    slots = {r["doc_id"]: r["s"] for r in table(spark, SF, "documents").select("doc_id", sharding.slot_of(F.col("doc_id"), F.lit(0)).alias("s")).collect()}
    weights = {}
    for r in rows:
        s = slots[r["doc_id"]]
        weights[s] = weights.get(s, 0) + len((r["text"] or "").encode()) + 1
    placed = greedy(weights, sharding.N_SHARDS)
    assert all(r["shard"] == placed[slots[r["doc_id"]]] for r in rows)


def test_run_gives_the_last_stage(spark, steps):
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, out.select("doc_id", "shard").collect())) == sorted(str(r) for r in [type(x)(doc_id=x["doc_id"], shard=x["shard"]) for x in steps["sharding"][1]])


def test_nothing_but_the_result_is_left(spark):
    import os

    root = f"{spark.conf.get('spark.checkpoint.dir')}/quillon"
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, SF)
    assert {x.rpartition("-")[0] for x in set(os.listdir(root)) - before} == {"sharding"} and out.count() > 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    """Nulls in any column, empty, blank and long texts, repeated rows, extra columns with clashing names, empty tables."""
    base = table(spark, SF, "documents").limit(20)
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(f"{tmp_path}/{t}.parquet")
    odd = [(1, None), (None, None), (None, "no id here, but five words and more"), (2, ""), (2, " \n"), (3, "one"), (3, "one"), (4, "é" * 700_000), (5, "long words " * 60_000)]
    rows = spark.createDataFrame(odd, "doc_id long, text string")
    docs = base.unionByName(rows, allowMissingColumns=True)
    extra = {c: F.lit(1) for c in ("fp", "Shard", "m_key", "bucket", "root", "component_id", "quality_score", "vslot", "size")}
    docs = materialize(docs.withColumns(extra), "odd")
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) - len(docs.columns) == (name == "sharding")
    texts = [r["text"] for r in rows]
    if name == "near_dedup":
        assert texts.count("one") == 1 and sum(not (t or "").strip() for t in texts) == 1
    elif name in ("decontaminate", "sharding"):
        assert all(texts.count(t) == [x for _, x in odd].count(t) for _, t in odd)
    else:
        assert rows
    assert stage(spark, spark.createDataFrame([], docs.schema), str(tmp_path)).count() == 0
