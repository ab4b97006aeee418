import random

from quillon.operators import graph
from tests.plans import most_rows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_contradictions(spark):
    out = graph.check_consistency(docs(spark, "Lisa likes tennis. Lisa doesn't likes tennis.", "Lisa likes tennis. Lisa likes golf.", "", None))
    rows = {r["essayId"]: r for r in out.collect()}
    assert [rows[i]["semanticErrors"] for i in range(4)] == [1.0, 0.0, 0.0, 0.0]
    assert "contradicts" in rows[0]["feedback_detail"]


def test_source_text_comes_first(spark):
    source = spark.createDataFrame([("Lisa likes tennis.",)], "text string")
    out = graph.check_consistency(docs(spark, "Lisa doesn't likes tennis.", "Lisa plays golf."), source=source)
    assert {r["essayId"]: r["semanticErrors"] for r in out.collect()} == {0: 1.0, 1: 0.0}


def test_disjoint_classes(spark):
    subclass = spark.createDataFrame([("boy", "man"), ("girl", "woman")], "child string, parent string")
    disjoint = spark.createDataFrame([("man", "woman")], "a string, b string")
    out = graph.check_consistency(docs(spark, "Kim is a boy. Kim is a girl.", "Kim is a boy."), subclass, disjoint)
    assert {r["essayId"]: r["consistencyErrors"] for r in out.collect()} == {0: 1.0, 1: 0.0}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r["child"], r["parent"]): r["steps"] for r in graph.closure(edges).collect()}
    assert got[("d", "c")] == 3 and ("a", "a") not in got and len(got) == 9


def test_links(spark):
    nodes = spark.createDataFrame([("x", "u1", "red car", 1), ("x", "u2", "red fast car", 2)], "kind string, uri string, text string, ord int")
    mentions = spark.createDataFrame([("a red car",), ("blue boat",)], "text string")
    assert {r["text"]: r["uri"] for r in graph.fuzzy_links(mentions, nodes).collect()} == {"a red car": "u1"}
    stems = nodes.withColumn("stem", nodes["text"])
    own = spark.createDataFrame([("x", "red car", "red car"), ("x", "cars", "red fast car"), ("x", "none", "none")], "kind string, text string, stem string")
    assert {r["mention"]: r["uri"] for r in graph.entity_links(own, stems).collect()} == {"red car": "u1", "cars": "u2", "none": None}


def test_rules_and_parsers(spark):
    rows = spark.createDataFrame([(1, 0, "rex", "is", "big dog")], "doc_id long, sent int, subject string, predicate string, object string")
    kinds = spark.createDataFrame([("rex", "dog")], "child string, parent string")
    assert graph.adjective_rule(rows, kinds).first()["object"] == "big"
    lines = spark.createDataFrame([("0.9 (Lisa; likes; tennis; T:today)",), ("0.5 Context(x,1,2):(a; b; c)",), ("junk",)], "value string")
    got = graph.parse_extractor(lines).collect()
    assert [(r["subject"], r["object"], r["time"]) for r in got] == [("Lisa", "tennis", "T:today")]
    axioms = spark.createDataFrame([("SubClassOf(<http://x#Boy> <http://x#Man>)",)], "value string")
    assert graph.parse_axioms(axioms).first()["sentence"] == "Man is a general kind of Boy"


ROWS = "doc_id long, sent int, subject string, predicate string, object string"


def test_classes_and_subclasses_conflict(spark):
    rows = spark.createDataFrame([(1, 0, "kim", "likes", "poodle"), (1, 1, "kim", "not likes", "dog"), (2, 0, "kim", "not likes", "dog"), (3, 0, "kim", "likes", "cat"), (3, 1, "kim", "not likes", "dog")], ROWS)
    kinds = spark.createDataFrame([("poodle", "dog"), ("dog", "animal")], "child string, parent string")
    got = graph.inherited_conflicts(rows, graph.negations(rows), kinds).collect()
    assert [(r["doc_id"], r["sent"], r["with_sent"], r["with_object"]) for r in got] == [(1, 1, 0, "poodle")]


def test_rejected_triples_hold_nothing_back(spark):
    rows = spark.createDataFrame([(1, 0, "kim", "likes", "tea"), (1, 1, "kim", "not likes", "tea"), (1, 2, "kim", "likes", "tea"), (2, 0, "kim", "drinks", "tea")], ROWS)
    got = sorted((r["doc_id"], r["sent"], r["kept"], r["with_sent"]) for r in graph.insert_in_order(rows, graph.negations(rows)).collect())
    assert got == [(1, 0, True, None), (1, 1, False, 0), (1, 2, True, None), (2, 0, True, None)]


def test_pronouns(spark):
    rows = spark.createDataFrame([(1, 0, "She", "sings", "songs"), (1, 1, "Kim", "likes", "tea"), (1, 2, "She", "drinks", "tea"), (2, 0, "it", "rains", "cats")], ROWS)
    got = {(r["doc_id"], r["sent"]): r["subject"] for r in graph.resolve_pronouns(rows).collect()}
    assert got == {(1, 0): "She", (1, 1): "Kim", (1, 2): "Kim", (2, 0): "it"}


def test_lexicon(spark):
    words = spark.createDataFrame([("hound",), ("poodle",), ("slow",)], "word string")
    nodes = spark.createDataFrame([("dog", "u#dog", 1), ("animal", "u#animal", 2), ("fast", "u#fast", 3)], "text string, uri string, ord int")
    lexicon = spark.createDataFrame([("hound", "synonym", "dog"), ("hound", "hypernym", "animal"), ("poodle", "hypernym", "animal"), ("poodle", "hypernym", "dog"), ("slow", "antonym", "fast")], "word string, relation string, other string")
    same, above, against = graph.lexical_edges(words, nodes, lexicon)
    assert [tuple(r) for r in same.collect()] == [("hound", "u#dog")]
    assert [tuple(r) for r in above.collect()] == [("poodle", "u#dog")]
    assert {tuple(r) for r in against.collect()} == {("slow", "u#fast"), ("u#fast", "slow")}


def _related(edges):
    """Pairs of names of which one is above the other."""
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = set()
    for start in up:
        todo, seen = list(up[start]), set()
        while todo:
            if (one := todo.pop()) not in seen:
                seen.add(one)
                todo += up.get(one, ())
        out |= {(start, p) for p in seen} | {(p, start) for p in seen}
    return out


def test_inherited_conflicts_equal_all_pairs(spark):
    rng = random.Random(2)
    edges = [("a", "b"), ("b", "c"), ("x", "c"), ("y", "x"), ("p", "q"), ("q", "p")]
    rows = sorted({(rng.randint(0, 3), rng.randint(0, 30), "s", rng.choice(["likes", "not likes", "sees"]), rng.choice("abcxypqz")) for _ in range(160)})
    near = _related(edges)
    expected = {}
    for d, n, s, p, o in rows:
        met = [(m, q, r) for e, m, t, q, r in rows if (e, t) == (d, s) and m < n and {p, q} == {"likes", "not likes"} and (o == r or (o, r) in near)]
        if met:
            expected[d, n, s, p, o] = min(met)
    df = spark.createDataFrame(rows, "doc_id long, sent int, subject string, predicate string, object string")
    got = graph.inherited_conflicts(df, graph.negations(df), spark.createDataFrame(edges, "child string, parent string"))
    assert {tuple(r)[:5]: tuple(r)[5:] for r in got.collect()} == expected


def test_what_lies_below_a_class_is_not_met(spark):
    edges = spark.range(2000).select(graph.F.concat(graph.F.lit("leaf"), "id").alias("child"), graph.F.lit("top").alias("parent"))
    names = spark.createDataFrame([("top",), ("leaf7",)], "name string")
    assert {(r["child"], r["parent"]) for r in graph.closure(edges, names).collect()} == {("leaf7", "top")}
    rows = [(d, n, "s", p, o) for d in range(50) for n, (p, o) in enumerate([("likes", "top"), ("not likes", "leaf7")])]
    df = spark.createDataFrame(rows, "doc_id long, sent int, subject string, predicate string, object string")
    wrong = graph.inherited_conflicts(df, graph.negations(df), edges)
    assert wrong.count() == 50 and most_rows(wrong) <= 4 * len(rows)
