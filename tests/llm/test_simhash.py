import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import simhash
from tests.llm import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBÉ \t\n x", max_size=60)), max_size=6))
def test_fingerprints_equal_the_definition(texts):
    got = simhash.fingerprints([None if t is None else t.encode() for t in texts])
    assert got.tolist() == [brute.fingerprint(t) for t in texts]


def test_fingerprint_of_a_text_in_pieces(monkeypatch):
    text = prose(np.random.default_rng(0), 4000)
    whole = simhash.fingerprints([text.encode()])
    monkeypatch.setattr(simhash, "_PIECE", 97)
    assert simhash.fingerprints([text.encode()]).tolist() == whole.tolist() == [brute.fingerprint(text)]


def test_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(1, 40))), "x") for i in range(120)]
    rows += [(200 + i, t[:-1], "x") for i, (_, t, _) in enumerate(rows[:40])]
    rows += [(300 + i, rows[7][1], "x") for i in range(30)] + [(400, None, "x"), (401, "", "x"), (402, " \n", "x"), (7, rows[7][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.groups(docs).collect()
    expected = brute.groups({i: brute.fingerprint(t) for i, t, _ in rows})
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(expected.items())
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def near(rng, base, n, most):
    out = set()
    while len(out) < n:
        x = base
        for b in rng.choice(64, int(rng.integers(1, most + 1)), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_large_buckets_are_split_without_losing_links(spark, seed):
    """Many fingerprints that agree in 40 bits, so that buckets go over their limit; chains of links across them."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**63))
    free = rng.choice(64, 22, replace=False)
    prints = {base}
    for _ in range(1500):
        x = base
        for b in free[rng.random(22) < 0.5]:
            x ^= 1 << int(b)
        prints.add(x)
    prints |= near(rng, base, 300, 3)
    values = np.array(sorted(prints), np.uint64)
    rows = list(zip(range(len(values)), values.view(np.int64).tolist(), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.group_of(df).collect()}
    # All pairs, in numpy.
    forest = brute.Forest()
    for i, v in enumerate(values):
        forest.find(i)
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ v) <= 3).tolist():
            forest.join(i, j)
    assert {fp: forest.find(i) for i, fp in rows} == got


def test_keys_reach_every_pair_within_three_bits():
    rng = np.random.default_rng(0)
    masks = [m for _, m in simhash.chain_masks()]
    for _ in range(3000):
        x = int(rng.integers(0, 2**63))
        y = x
        for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            y ^= 1 << int(b)
        assert any((x ^ y) & m == 0 for m in masks)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, w_id int")
    assert simhash.groups(docs).count() == simhash.dedup(docs).count() == simhash.dedup_similar(docs).count() == 0


def test_repeated_and_missing_ids(spark):
    rows = [(None, "one two three four"), (None, "five six seven eight nine"), (3, "one two three four"), (3, "five six seven eight"), (3, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.groups(docs).count() == 5
    kept = [r["text"] for r in simhash.dedup(docs).collect()]
    prints = {brute.fingerprint(t) for _, t in rows}
    assert len(kept) == len({brute.fingerprint(t) for t in kept}) == len(set(brute.groups({i: p for i, p in enumerate(prints)}).values()))


RADIUS = 24


def test_ring_filter_loses_nothing():
    rng = np.random.default_rng(3)
    for radius in (0, 3, 24, 40):
        diff = np.packbits(rng.random((4000, 128)) < rng.uniform(0, 2 * (radius + 4) / 128, (4000, 1)), axis=1).view(np.uint64)
        assert (simhash.within_ring(diff, radius) == (np.bitwise_count(diff).sum(axis=1) <= radius)).all()


@pytest.mark.parametrize("block", [4, 16])
def test_chain_is_one_group_whatever_the_block(spark, block):
    """Sixty prints, each within reach of the next alone."""
    rng = np.random.default_rng(60)
    p, chain = rng.integers(0, 2**63, 2).astype(np.uint64), []
    for _ in range(60):
        chain.append(p)
        p = p ^ np.packbits(np.isin(np.arange(128), rng.choice(128, 20, replace=False))).view(np.uint64)
    nodes = spark.createDataFrame([(i, bytearray(p.tobytes()), [1]) for i, p in enumerate(chain)], "node long, fp binary, bands array<long>")
    got = simhash._graph.components(simhash.similar_links(nodes, RADIUS, block)).collect()
    assert len(got) == 60 and {r["root"] for r in got} == {0}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_recall_at_the_threshold(spark):
    """Of pairs at a true similarity of 0.80 to 0.82 at least 95 % are found, and none below 0.8."""
    rng = np.random.default_rng(80)
    rows, near = [], set()
    for f in range(400):
        words = [f"{w}{rng.integers(1000)}" for w in rng.choice(WORDS, int(rng.integers(150, 500)))]
        edited = list(words)
        while True:
            edited[int(rng.integers(len(edited)))] = f"x{rng.integers(10**6)}"
            a, b = shingles(" ".join(words)), shingles(" ".join(edited))
            if len(a & b) / len(a | b) < (0.82 if f % 4 else 0.79):
                break
        if 5 * len(a & b) >= 4 * len(a | b):
            near.add(f)
        rows += [(2 * f, " ".join(words)), (2 * f + 1, " ".join(edited))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {f for f in range(400) if got[2 * f + 1] == 2 * f}
    assert all(got[2 * f] == 2 * f for f in range(400)) and found <= near
    assert len(near) > 200 and len(found) >= 0.95 * len(near)


def test_similar_copies_meet_and_others_do_not(spark):
    rng = np.random.default_rng(5)
    rows, families = [], 25
    for f in range(families):
        words = [f"{w}{rng.integers(100)}" for w in rng.choice(WORDS, 400)]
        rows.append((100 * f, " ".join(words)))
        for k in range(1, 5):
            edited = list(words)
            for at in rng.choice(400, 4, replace=False):
                edited[at] = "changed"
            rows.append((100 * f + k, " ".join(edited)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == {i: 100 * (i // 100) for i, _ in rows} | {9000: 9000, 9001: 9000}
    assert sorted(r["doc_id"] for r in simhash.dedup_similar(docs).collect()) == [*range(0, 100 * families, 100), 9000]


def test_large_buckets_of_similar_texts(spark):
    """Blocks far smaller than a group of copies give the same groups."""
    rng = np.random.default_rng(6)
    words = [f"{w}{rng.integers(100)}" for w in rng.choice(WORDS, 300)]
    texts = [" ".join(w if i != k % 300 else f"x{k}" for i, w in enumerate(words)) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash.materialize(simhash.with_wide_print(docs, bands="bands"), "test")
    from pyspark.sql import functions as F

    nodes = simhash.materialize(prints.select(F.xxhash64("fp").alias("node"), "fp", "bands").dropDuplicates(["node"]), "test-nodes")
    whole = simhash._graph.components(simhash.similar_links(nodes, RADIUS)).collect()
    parts = simhash._graph.components(simhash.similar_links(nodes, RADIUS, block=8)).collect()
    assert sorted(whole) == sorted(parts)


def test_links_of_members_that_no_other_block_stands_for(spark):
    """Texts near one member of a large bucket, and not near most others of its group."""
    rng = np.random.default_rng(7)
    flip = lambda x, places: np.bitwise_xor(x, np.packbits(np.isin(np.arange(128), places)).view(np.uint64))
    base = rng.integers(0, 2**63, 2).astype(np.uint64)
    prints = [flip(base, rng.choice(128, 10, replace=False)) for _ in range(150)]
    prints += [flip(prints[int(rng.integers(150))], rng.choice(128, 22, replace=False)) for _ in range(30)]
    forest = brute.Forest()
    for i, p in enumerate(prints):
        forest.find(i)
        for j in np.flatnonzero(np.bitwise_count(np.array(prints[:i] or [~p]) ^ p).sum(axis=1) <= RADIUS).tolist():
            forest.join(i, j)
    truth = {i: forest.find(i) for i in range(len(prints))}
    nodes = spark.createDataFrame([(i, bytearray(p.tobytes()), [1]) for i, p in enumerate(prints)], "node long, fp binary, bands array<long>")
    got = {r["node"]: r["root"] for r in simhash._graph.components(simhash.similar_links(nodes, RADIUS, block=8)).collect()}
    assert {i: got.get(i, i) for i in truth} == truth and sum(r == 0 for r in truth.values()) > 160


def test_groups_are_those_of_the_exact_similarity(spark):
    """Pairs just above and just below 0.8, which distances of fingerprints do not tell apart."""
    rng = np.random.default_rng(9)
    rows = []
    for f in range(40):
        words = [f"{w}{rng.integers(1000)}" for w in rng.choice(WORDS, 404)]
        # Five shingles an edit: 400 shingles, at 8 edits 360 / 440 = 0.82, at 10 edits 350 / 450 = 0.78.
        edited = [f"x{f}" if i in range(20, 20 + 40 * (8 if f % 2 else 10), 40) else w for i, w in enumerate(words)]
        rows += [(2 * f, " ".join(words)), (2 * f + 1, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = [simhash.wide_prints([t.encode()])[1][0] for _, t in rows]
    met = {f for f in range(40) if (keys[2 * f] == keys[2 * f + 1]).any()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == {i: i - i % 2 if i // 2 in met and i // 2 % 2 else i for i, _ in rows}
    assert len(met) > 30


def test_sets_link_at_the_threshold_and_not_below():
    a = np.arange(10)
    for other, linked in ((np.arange(8), True), (np.arange(7), False), (np.arange(1, 10), True)):
        edges = simhash._set_forest(np.array([5, 6]), np.r_[a, other], np.array([len(a), len(other)]))
        assert edges == ([(5, 6)] if linked else [])


def test_nodes_that_share_a_number(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(30)], "key string, node long")
    out = simhash.own_numbers(df, "key", "node").collect()
    assert len({r["node"] for r in out}) == 30 and sorted(r["key"] for r in out) == sorted(f"k{i}" for i in range(30))
