"""The consistency flow, its parts against plain versions."""

import random

from quillon.operators import consistency as K
from quillon.operators import graph
from tests.plans import most_rows

NODES = "kind string, uri string, text string, stem string, ord int"
ROWS = "doc_id long, sent int, subject string, predicate string, object string"
PAIRS = "a string, b string"
EDGES = "child string, parent string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def nodes(spark):
    return frame(spark, [("SubObj", "#Tennis", "tennis", "tenni", 1), ("SubObj", "#FastSport", "fast sport", "fast sport", 2), ("Pred", "#likes", "likes", "like", 1)], NODES)


def test_near_links_equal_all_pairs(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("a b c d e the the the".split()) for _ in range(rng.randint(1, 7)))
    known = [(f"u{i}", i, text()) for i in range(120)]
    asked = sorted({text() for _ in range(150)} | {""})

    def near(a: str):
        a = a.split(" ")
        for uri, _, b in known:
            b = b.split(" ")
            if 2 * sum(w in b for w in a) / (len(a) + len(b)) >= 0.7:
                return uri
        return None

    got = graph.fuzzy_links(frame(spark, [(x,) for x in asked], "text string"), frame(spark, known, "uri string, ord int, text string"))
    assert {r["text"]: r["uri"] for r in got.collect()} == {x: u for x in asked if (u := near(x))}


def test_chunks_and_seeds(spark):
    docs = frame(spark, [(1, "The fast sport is good. Lisa likes tennis!"), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["sent"], r["kind"], r["original"]) for r in K.chunks(docs).collect()}
    assert (1, 0, "SubObj", "fast sport") in got and {g[0] for g in got} == {1}
    found = {(r["uri"], r["original"]) for r in K.seeds(docs, nodes(spark)).collect()}
    assert ("#FastSport", "fast sport") in found and {u for u, _ in found} == {"#Tennis", "#FastSport", "#likes"}


def test_resolution_goes_from_equal_to_near(spark):
    asked = [("SubObj", "tennis", "tenni"), ("SubObj", "tennises", "tenni"), ("SubObj", "very fast sport", "veri fast sport"), ("SubObj", "moon", "moon"), ("Pred", "tennis", "tenni")]
    got = {(r["kind"], r["text"]): (r["uri"], r["how"]) for r in K.resolve(frame(spark, asked, "kind string, text string, stem string"), nodes(spark)).collect()}
    assert got == {
        ("SubObj", "tennis"): ("#Tennis", "by_text"), ("SubObj", "tennises"): ("#Tennis", "by_stem"), ("SubObj", "very fast sport"): ("#FastSport", "near_text"),
        ("SubObj", "moon"): (None, None), ("Pred", "tennis"): (None, None),
    }


def test_new_elements_are_attached_and_related(spark):
    asked = [("SubObj", "ping pong", "ping pong"), ("SubObj", "court game", "court game"), ("SubObj", "slow walk", "slow walk"), ("Pred", "not likes", "not like"), ("Pred", "sees often", "see often")]
    lexicon = frame(spark, [("ping pong", "synonym", "tennis"), ("ping pong", "hypernym", "fast sport"), ("court game", "hypernym", "fast sport"), ("slow walk", "antonym", "fast sport")], "word string, relation string, other string")
    elements, below, against = K.add_elements(frame(spark, asked, "kind string, text string, stem string"), nodes(spark), lexicon)
    assert {r["text"]: (r["uri"], r["how"]) for r in elements.collect()} == {
        "ping pong": ("#Tennis", "synonym"), "court game": ("#CourtGame", "new"), "slow walk": ("#SlowWalk", "new"), "not likes": ("#notLikes", "new"), "sees often": ("#seesOften", "new"),
    }
    assert [tuple(r) for r in below.collect()] == [("SubObj", "#CourtGame", "#FastSport")]
    assert {tuple(r) for r in against.collect()} == {(k, *p) for k, x, y in (("SubObj", "#SlowWalk", "#FastSport"), ("Pred", "#notLikes", "#likes")) for p in ((x, y), (y, x))}
    elements, below, against = K.add_elements(frame(spark, asked[:1], "kind string, text string, stem string"), nodes(spark))
    assert elements.first()["how"] == "new" and below.count() == against.count() == 0


def test_adjectives_and_special_classes(spark):
    rows = frame(spark, [(1, 0, "rex", "is", "big brown dog"), (1, 1, "rex", "likes", "tiny"), (2, 0, "tom", "is", "big dog")], ROWS)
    kinds = frame(spark, [("rex", "hound"), ("hound", "dog")], EDGES)
    tags = lambda t: K.F.transform(t, lambda w: K.F.when(w.isin("big", "brown"), "JJ").otherwise("NN"))
    stated, below = K.adjective_classes(rows, kinds, tags)
    assert {(r["subject"], r["predicate"], r["object"]) for r in stated.collect()} == {("rex", "is", "big"), ("rex", "is", "brown")}
    assert {(r["child"], r["parent"]) for r in below.collect()} == {("rex", "big dog"), ("rex", "brown dog")}
    entities = frame(spark, [(1, 0, 3, "PERSON"), (1, 0, 0, "ANIMAL"), (2, 0, 0, "PERSON")], "doc_id long, sent int, pos int, type string")
    assert [(r["child"], r["parent"]) for r in K.special_classes(rows, entities).collect()] == [("rex", "big brown dog")]


def test_patterns_and_index(spark):
    stated = frame(spark, [(1, 3, "kim", "likes", "tea"), (1, 1, "kim", "drinks", "tea"), (1, 0, "tea", "likes", "kim"), (2, 0, "kim", "likes", "tea")], ROWS)
    assert K.matching(stated, subject="kim", obj="tea").count() == 3 and K.matching(stated).count() == 4
    asked = frame(spark, [(1, 9, "kim", "likes", "tea"), (1, 9, "kim", "is", "tea"), (1, 9, "kim", "hates", "tea")], ROWS)
    assert {r["predicate"]: r["sent"] for r in K.statement_index(asked, stated).collect()} == {"likes": 0, "is": 0, "hates": None}


def test_opposing_statement(spark):
    kinds = frame(spark, [("poodle", "dog"), ("dog", "animal"), ("pup", "poodle")], EDGES)
    stated = frame(spark, [(1, 0, "kim", "likes", "animal"), (1, 1, "kim", "likes", "dog"), (1, 2, "kim", "likes", "pup"), (2, 0, "kim", "likes", "pup"), (2, 1, "kim", "likes", "poodle")], ROWS)
    wrong = frame(spark, [(1, 5, "kim", "hates", "dog"), (2, 5, "kim", "hates", "dog"), (3, 5, "kim", "hates", "dog"), (4, 1, "kim", "type", "boy"), (5, 1, "kim", "type", "rock")], ROWS)
    got = {r["doc_id"]: (r["with_predicate"], r["with_object"]) for r in K.opposing(wrong, stated, frame(spark, [("likes", "hates")], PAIRS), kinds, frame(spark, [("girl", "boy")], PAIRS)).collect()}
    assert got == {1: ("likes", "animal"), 2: ("likes", "pup"), 3: (None, None), 4: ("type", "girl"), 5: (None, None)}


STEPS = "doc_id long, sent int, step int, kind string, subject string, predicate string, object string"


def counts(spark, rows, turbo, kinds=(("boy", "man"), ("girl", "woman")), classes=(("man", "woman"),), properties=(("likes", "hates"),)):
    done = K.guarded(frame(spark, rows, STEPS), frame(spark, list(kinds), EDGES), frame(spark, list(classes), PAIRS), frame(spark, list(properties), PAIRS), turbo)
    docs = frame(spark, [(i,) for i in sorted({r[0] for r in rows}, reverse=True)], "doc_id long")
    return {r["essayId"]: (r["consistencyErrors"], r["semanticErrors"]) for r in K.error_counts(done, docs).collect()}


def test_errors_of_additions_count_on_replay_only(spark):
    rows = [
        # An addition that contradicts, in a sentence whose statement is fine.
        (1, 0, 1, "triple", "kim", "type", "boy"), (1, 1, 0, "axiom", "kim", "type", "girl"), (1, 1, 1, "triple", "kim", "likes", "tea"),
        # The same, and the statement fails.
        (2, 0, 1, "triple", "kim", "type", "boy"), (2, 0, 2, "triple", "kim", "likes", "tea"), (2, 1, 0, "axiom", "kim", "type", "girl"), (2, 1, 1, "triple", "kim", "hates", "tea"),
        (3, 0, 1, "triple", "kim", "type", "boy"), (3, 1, 1, "triple", "kim", "type", "girl"), (3, 2, 1, "triple", "kim", "type", "man"),
    ]
    assert counts(spark, rows, True) == {1: (0, 0), 2: (1, 1), 3: (0, 1)}
    assert counts(spark, rows, False) == {1: (1, 0), 2: (1, 1), 3: (0, 1)}


def test_what_is_rejected_holds_nothing_back(spark):
    rows = [(1, 0, 1, "triple", "kim", "likes", "dog"), (1, 1, 1, "triple", "kim", "hates", "poodle"), (1, 2, 1, "triple", "kim", "likes", "poodle"), (1, 3, 1, "triple", "tom", "hates", "dog")]
    assert counts(spark, rows, True, kinds=(("poodle", "dog"),)) == {1: (0, 1)}


def test_classes_a_document_makes_itself(spark):
    rows = [(1, 0, 1, "triple", "kim", "type", "pal"), (1, 1, 1, "triple", "kim", "type", "girl"), (1, 2, 0, "axiom", "pal", "subclass", "boy")]
    assert counts(spark, rows, False) == {1: (1, 0)}


def test_the_whole_flow(spark):
    docs = frame(spark, [(1, "Lisa likes tennis. Lisa does not likes tennis."), (2, "Kim is a boy. Kim is a girl."), (3, "Lisa does not likes golf."), (4, ""), (5, None)], "doc_id long, text string")
    classes, none = frame(spark, [("boy", "girl")], PAIRS), frame(spark, [], PAIRS)
    known = frame(spark, [("SubObj", "boy", "boy", "boi", 1), ("SubObj", "girl", "girl", "girl", 2), ("Pred", "likes", "likes", "like", 1)], NODES)
    source = frame(spark, [("Lisa likes golf.",)], "text string")
    counted, said = K.run(docs, known, frame(spark, [], EDGES), classes, none, source=source)
    rows = counted.collect()
    assert [(r["essayId"], r["consistencyErrors"], r["semanticErrors"]) for r in rows] == [(1, 0, 1), (2, 0, 1), (3, 0, 1), (4, 0, 0), (5, 0, 0)]
    text = {r["doc_id"]: r["feedback"] for r in said.collect()}
    assert text[1] == "Relation 'Lisa does not likes tennis.' is inconsistent with a relation in ontology: 'Lisa likes tennis.'."
    assert text[2].endswith("'Kim is a boy.'.") and text[3].endswith("'Lisa likes golf.' (from source text).")


def test_documents_are_no_frames_of_their_own(spark):
    """Small documents share a batch: a frame for each cost 60 ms, and a query of many documents its time."""
    rows = [(d, n, step, kind, "s", p, o) for d in range(300) for n, (step, kind, p, o) in enumerate([(1, "triple", "likes", "a"), (1, "triple", "not likes", "b"), (0, "axiom", "type", "a")])]
    df = frame(spark, rows, "doc_id long, sent int, step int, kind string, subject string, predicate string, object string")
    out = K.guarded(df, frame(spark, [("b", "a")], EDGES), frame(spark, [], PAIRS), frame(spark, [("not likes", "likes")], PAIRS))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert {(r["sent"], r["kept"], r["error"]) for r in out.collect()} == {(0, True, None), (1, False, "semantic"), (2, True, None)} and out.count() == len(rows)


def test_nodes_of_one_text_are_met_once(spark):
    nodes = spark.range(4000).selectExpr("concat('u', id) AS uri", "cast(4000 - id AS int) AS ord", "if(id % 2 = 0, 'red car', 'blue boat') AS text")
    asked = spark.createDataFrame([("red cars car",), ("red car",), ("boat",)], "text string")
    near = graph.fuzzy_links(asked, nodes, 0.6)
    assert {r["text"]: (r["uri"], round(r["similarity"], 6)) for r in near.collect()} == {"red cars car": ("u3998", 0.8), "red car": ("u3998", 1.0), "boat": ("u3999", 0.666667)}
    assert most_rows(near) <= 4000


def test_the_rarest_part_is_looked_up(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 2), n // 2, "s", rng.choice("pq"), rng.choice("abcd") + str(n % 40)) for n in range(600)]
    asked = sorted({(d, "s", rng.choice(["p", "q", "is"]), o) for d, _, _, _, o in rows} | {(1, "s", "p", None), (None, "s", "p", "a0"), (0, "s", "type", "s")}, key=str)

    def first(d, s, p, o):
        sents = {n for e, n, *_ in rows if e == d}
        words = lambda n: ({x for e, m, a, _, b in rows if (e, m) == (d, n) for x in (a, b)}, {q for e, m, _, q, _ in rows if (e, m) == (d, n)})
        return min((n for n in sents if {s, o} <= words(n)[0] and (p in ("is", "type") or p in words(n)[1])), default=None)

    stated = frame(spark, rows, ROWS)
    got = K.statement_index(frame(spark, asked, "doc_id long, subject string, predicate string, object string"), stated)
    assert {tuple(r)[:4]: r["sent"] for r in got.collect()} == {a: first(*a) for a in asked}
    assert most_rows(got) <= len(rows) + len(asked)
