"""Semantic consistency: triples, an ontology as edges, conflicts and feedback.

The reasoner is a set of rules in joins: subclass closure, inherited types,
disjoint classes and disjoint properties (symmetric).  Full OWL reasoning is
out of scope.  Triples conflict with earlier ones of the same document, in the
order (sentence, triple).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quillon.functions import text as T
from quillon.sources.staging import materialize, small

#: Subject, verb and object of a plain sentence.
CLAUSE = r"(?i)^((?:(?:a|an|the) )?[\p{L}']+)\s+((?:does not|doesn't|do not|don't|is not|isn't|can not|cannot)\s+)?([\p{L}]+)\s+(.+?)[.!?]*$"


def triples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sent, subject, predicate, object) by a rule for plain clauses; other sentences give none."""
    # One match gives all parts: marked, and apart by a character that only the last can hold.
    whole = lambda x: F.when(x.startswith("\x02"), "").otherwise(F.regexp_replace(x, CLAUSE + "(?s:.*)", "\x02$1\x01$2\x01$3\x01$4"))
    found = docs.select("doc_id", F.posexplode(F.transform(T.sentences(F.col(text)), whole)).alias("sent", "m")).filter(F.col("m").startswith("\x02"))
    at = lambda i: F.lower(F.get(F.split(F.expr("substring(m, 2)"), "\x01", 4), F.lit(i - 1)))
    rows = found.select(
        "doc_id", "sent", T.strip_article(at(1)).alias("subject"),
        F.when(at(2) != "", F.concat(F.lit("not "), at(3))).otherwise(at(3)).alias("predicate"), T.strip_article(at(4)).alias("object"),
    )
    return usable(rows)


def usable(rows: DataFrame) -> DataFrame:
    """Triples with all parts, whose subject is not their object."""
    full = reduce(lambda a, b: a & b, [F.trim(F.col(c)) != "" for c in ("subject", "predicate", "object")])
    return rows.filter(full & (F.lower("subject") != F.lower("object")))


def parse_extractor(lines: DataFrame, line: str = "value") -> DataFrame:
    """(confidence, subject, predicate, object, time) of lines ``0.9 (s; p; o; T:when)``; context lines give none."""
    m = r"^\s*([0-9.]+)\s*\((.*)\)\s*$"
    parts = F.transform(F.split(F.regexp_extract(line, m, 2), ";"), lambda x: F.trim(x))
    rows = lines.filter(F.col(line).rlike(m) & ~F.contains(line, F.lit("Context("))).select(F.regexp_extract(line, m, 1).cast("double").alias("confidence"), parts.alias("p"))
    rest = F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))
    timed = lambda x: x.startswith("T:") | x.startswith("L:")
    args = F.filter(rest, lambda x: ~timed(x))
    when = F.array_join(F.filter(rest, timed), " ")
    out = rows.select("confidence", F.get("p", F.lit(0)).alias("subject"), F.get("p", F.lit(1)).alias("predicate"), F.explode(args).alias("object"), when.alias("time"))
    return usable(out)


def closure(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(child, parent, steps): all ancestors over edges (child, parent), fewest steps.

    Each round joins pairs with pairs, so rounds grow with the logarithm of the
    longest path, and is written, so no round is made twice.  It ends when no
    pair is new or shorter; cycles give no pair of a node with itself.

    With ``of`` (one column of names) the ancestors of those are all there,
    those of other names may be missing: a name that is neither asked for nor
    above another one is on nobody's way up.
    """
    edges = edges.select("child", "parent")
    if of is not None:
        way = of.select(F.col(of.columns[0]).alias("child")).unionByName(edges.select(F.col("parent").alias("child"))).distinct()
        edges = edges.join(way, "child", "left_semi")
    now = materialize(edges.filter("child <> parent").distinct().withColumn("steps", F.lit(1)), "closure")
    measure = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum("steps")).first())
    last, state = None, measure(now)
    while state != last and state[0]:
        far = now.select(F.col("child").alias("mid"), "parent", F.col("steps").alias("more"))
        longer = now.select("child", F.col("parent").alias("mid"), "steps").join(far, "mid").select("child", "parent", (F.col("steps") + F.col("more")).alias("steps"))
        every = now.unionByName(longer.filter("child <> parent")).groupBy("child", "parent").agg(F.min("steps").alias("steps"))
        now = materialize(every, "closure")
        last, state = state, measure(now)
    return now


def symmetric(pairs: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of a relation."""
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def negations(rows: DataFrame) -> DataFrame:
    """(a, b): a predicate with ``not`` and the one it denies."""
    p = rows.select(F.col("predicate").alias("a")).distinct().filter(F.col("a").startswith("not "))
    return p.select("a", F.expr("substring(a, 5)").alias("b"))


def entity_links(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mention, uri): exact text, else equal stem, else none; ties to the least order.

    ``mentions`` is (kind, text, stem), ``nodes`` (kind, uri, text, stem, ord).
    """
    exact = nodes.groupBy("kind", "text").agg(F.min_by("uri", "ord").alias("by_text"))
    stem = nodes.groupBy("kind", "stem").agg(F.min_by("uri", "ord").alias("by_stem"))
    joined = mentions.join(exact, ["kind", "text"], "left").join(stem, ["kind", "stem"], "left")
    return joined.select("kind", F.col("text").alias("mention"), F.coalesce("by_text", "by_stem").alias("uri"))


def fuzzy_links(mentions: DataFrame, nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """(text, uri, similarity): the first node (by ord) whose words overlap at least ``least``.

    2 * (words of the mention, repeats counted, that the node has) / (words of both).
    Of n words at least ``least * (n + 1) / 2`` must be in the node, so at least
    one of the rarest others plus one is: mentions meet nodes on those alone,
    and words that many nodes share are probed only where nothing rarer is left.
    Of nodes with the same text only the first can be found, so texts meet texts.
    """
    own = mentions.select("text").distinct().withColumn("a", F.split("text", " "))
    named = nodes.groupBy(F.col("text").alias("name")).agg(F.min("ord").alias("ord"))
    far = named.select("name", "ord", F.split("name", " ").alias("b")).select("name", "ord", "b", F.explode(F.array_distinct("b")).alias("word"))
    often = far.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    words = own.select("text", "a", F.explode("a").alias("word")).join(often, "word", "left").groupBy("text", "a")
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")))
    # A little is taken off so that rounding never makes the prefix too short.
    needed = F.ceil(F.lit(least / 2) * (F.size("a") + 1) - F.lit(1e-9))
    probes = words.agg(rare.alias("r")).select("text", "a", F.explode(F.array_distinct(F.slice("r", F.lit(1), F.greatest(F.size("a") - needed + 1, F.lit(0)).cast("int")))).alias("p"))
    probes = probes.filter("p.df > 0").select("text", "a", F.col("p.word").alias("word"))
    short = F.size("b") <= (2 / least - 1) * F.size("a") + 1e-9
    hit = F.size(F.filter("a", lambda w: F.array_contains("b", w)))
    scored = probes.join(far, "word").filter(short).withColumn("similarity", 2.0 * hit / (F.size("a") + F.size("b"))).filter(F.col("similarity") >= least)
    # A pair that meets on several words is the same each time.
    best = scored.groupBy("text").agg(F.min(F.struct("ord", "name", "similarity")).alias("m")).select("text", "m.*")
    uris = nodes.select("ord", F.col("text").alias("name"), "uri").join(small(materialize(best, "near")), ["ord", "name"])
    return uris.groupBy("text").agg(F.min("uri").alias("uri"), F.min("similarity").alias("similarity"))


def property_conflicts(rows: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Triples that contradict an earlier one of their document: same subject and object, disjoint predicates.

    ``rows`` is (doc_id, sent, subject, predicate, object); the result adds
    (with_sent, with_predicate) of the earliest such triple.
    """
    same = ["doc_id", "subject", "object", "with_predicate"]
    earliest = rows.withColumnRenamed("predicate", "with_predicate").groupBy(*same).agg(F.min("sent").alias("with_sent"))
    pairs = symmetric(disjoint).select(F.col("a").alias("predicate"), F.col("b").alias("with_predicate"))
    joined = rows.join(small(materialize(pairs, "rivals")), "predicate").join(earliest, same).filter("with_sent < sent")
    first = F.min(F.struct("with_sent", "with_predicate")).alias("w")
    agg = joined.groupBy("doc_id", "sent", "subject", "predicate", "object").agg(first)
    return agg.select("doc_id", "sent", "subject", "predicate", "object", "w.with_sent", "w.with_predicate")


def inherited_conflicts(rows: DataFrame, disjoint: DataFrame, subclass: DataFrame) -> DataFrame:
    """As :func:`property_conflicts`, where an earlier statement about a class also speaks of its subclasses, and the other way round.

    Statements only go up: they are met under their own object by those about it
    or below it, and under each ancestor of it by those about that one.  Of each
    such place the earliest statement decides, so the cost is a document's
    statements times the height of the ontology, whatever lies below a class.
    """
    up = small(closure(subclass, rows.select("object")).select(F.col("child").alias("object"), F.col("parent").alias("about")))
    pairs = small(materialize(symmetric(disjoint).select(F.col("a").alias("predicate"), F.col("b").alias("with_predicate")), "rivals"))
    keys = ["doc_id", "sent", "subject", "predicate", "object"]
    said = rows.select(*keys)
    here = lambda df, side: df.withColumns({"about": F.col("object"), "side": F.lit(side)})
    above = lambda df, side: df.join(up, "object").withColumn("side", F.lit(side))
    place = ["doc_id", "subject", "with_predicate", "side", "about"]
    known = here(said, 0).unionByName(above(said, 1)).withColumnRenamed("predicate", "with_predicate")
    known = known.groupBy(*place).agg(F.min(F.struct(F.col("sent").alias("with_sent"), F.col("object").alias("with_object"))).alias("k"))
    asked = said.distinct().join(pairs, "predicate")
    asked = here(asked, 0).unionByName(above(asked, 0)).unionByName(here(asked, 1))
    met = asked.join(known, place).filter("k.with_sent < sent")
    first = met.groupBy(*keys).agg(F.min(F.struct("k.with_sent", "with_predicate", "k.with_object")).alias("w"))
    return first.select(*keys, "w.*")


def insert_in_order(rows: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``rows`` (doc_id, sent, subject, predicate, object) with ``kept`` and ``with_sent``, inserted one by one.

    A triple that contradicts one kept before is rejected and holds nothing
    back from then on; ``with_sent`` names the earliest it contradicts.  A
    document is a group, so its sentences bound what a task holds at a time.
    """
    pairs = symmetric(disjoint).groupBy("a").agg(F.collect_set("b").alias("against"))  # few for each predicate
    joined = rows.select("doc_id", "sent", "subject", "predicate", "object").join(pairs, rows["predicate"] == pairs["a"], "left").drop("a")
    own = rows.select("doc_id", "sent", "subject", "predicate", "object").schema.fields
    schema = StructType([*own, StructField("kept", BooleanType()), StructField("with_sent", own[1].dataType)])

    def run(group):
        group = group.sort_values(["sent", "subject", "predicate", "object"], kind="stable")
        seen: dict[tuple, int] = {}
        hit = []
        for r in group.itertuples():
            against = [] if r.against is None else [seen[k] for b in r.against if (k := (r.subject, b, r.object)) in seen]
            hit.append(min(against) if against else None)
            if not against:
                seen.setdefault((r.subject, r.predicate, r.object), r.sent)
        out = group.drop(columns="against")
        out["kept"] = [h is None for h in hit]
        out["with_sent"] = pd.Series(hit, index=out.index, dtype="Int64")
        return out

    return joined.groupBy("doc_id").applyInPandas(run, schema)


PRONOUNS = ("he", "she", "it", "they")


def resolve_pronouns(rows: DataFrame) -> DataFrame:
    """Subjects that are pronouns become the last subject before them that is none, if there is one: the default of the coreference plug-in."""
    before = Window.partitionBy("doc_id").orderBy("sent", "predicate", "object").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(~F.lower("subject").isin(*PRONOUNS), F.col("subject"))
    last = F.last(named, ignorenulls=True).over(before)
    return rows.withColumn("subject", F.coalesce(named, last, F.col("subject")))


def lexical_edges(words: DataFrame, nodes: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a lexicon says of new ``words`` (word) next to known ``nodes`` (text, uri, ord).

    ``lexicon`` is (word, relation, other) with relations synonym, hypernym and
    antonym.  Returns (word, uri) of the first known synonym; (child, parent)
    under the first known hypernym of words without one; and (a, b) of
    antonyms that are known, both ways.
    """
    met = words.select("word").distinct().join(lexicon, "word").join(nodes.select(F.col("text").alias("other"), "uri", "ord"), "other")
    same = met.filter("relation = 'synonym'").groupBy("word").agg(F.min_by("uri", "ord").alias("uri"))
    above = met.filter("relation = 'hypernym'").join(same, "word", "left_anti").groupBy("word").agg(F.min_by("uri", "ord").alias("parent"))
    against = met.filter("relation = 'antonym'").select(F.col("word").alias("a"), F.col("uri").alias("b"))
    return same, above.select(F.col("word").alias("child"), "parent"), symmetric(against)


def class_conflicts(types: DataFrame, subclass: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(doc_id, entity, a, b): entities that inherit two disjoint classes. ``types`` is (doc_id, entity, class)."""
    up = closure(subclass).select(F.col("child").alias("class"), F.col("parent").alias("ancestor"))
    own = types.select("doc_id", "entity", F.col("class").alias("ancestor"))
    every = own.unionByName(types.join(up, "class").select("doc_id", "entity", "ancestor")).distinct()
    pairs = symmetric(disjoint).filter("a < b")
    left = every.select("doc_id", "entity", F.col("ancestor").alias("a")).join(pairs, "a")
    return left.join(every.select("doc_id", "entity", F.col("ancestor").alias("b")), ["doc_id", "entity", "b"]).select("doc_id", "entity", "a", "b")


def propagate(rows: DataFrame, subclass: DataFrame) -> DataFrame:
    """Statements about a class hold for its subclasses: (doc_id, sent, subject, predicate, object, inferred)."""
    down = closure(subclass).select(F.col("parent").alias("object"), F.col("child").alias("sub"))
    more = rows.join(down, "object").select("doc_id", "sent", "subject", "predicate", F.col("sub").alias("object"), F.lit(True).alias("inferred"))
    return rows.withColumn("inferred", F.lit(False)).unionByName(more)


def adjective_rule(rows: DataFrame, subclass: DataFrame) -> DataFrame:
    """``s is ADJ NOUN`` where s is a NOUN also says ``s is ADJ``: the added triples."""
    pair = rows.filter(F.col("object").rlike(r"^\S+ \S+$")).withColumns({"adjective": F.substring_index("object", " ", 1), "noun": F.substring_index("object", " ", -1)})
    kinds = subclass.select(F.col("child").alias("subject"), F.col("parent").alias("noun"))
    return pair.join(kinds, ["subject", "noun"], "left_semi").select("doc_id", "sent", "subject", "predicate", F.col("adjective").alias("object"))


def sentence_of(kind: Column, a: Column, b: Column) -> Column:
    """An axiom in words."""
    return (
        F.when(kind == "DisjointClasses", F.concat(a, F.lit(" is different from "), b))
        .when(kind == "DisjointObjectProperties", F.concat(a, F.lit(" is the opposite of "), b))
        .when(kind == "SubClassOf", F.concat(b, F.lit(" is a general kind of "), a))
        .otherwise(F.concat_ws(" ", a, kind, b))
    )


def parse_axioms(lines: DataFrame, line: str = "value") -> DataFrame:
    """(kind, a, b, sentence) of ``Kind(<uri#a> <uri#b>)``."""
    m = r"^\s*(\w+)\(<([^>]*)>\s*<([^>]*)>\)"
    rows = lines.filter(F.col(line).rlike(m)).select(F.regexp_extract(line, m, 1).alias("kind"), T.fragment(F.regexp_extract(line, m, 2)).alias("a"), T.fragment(F.regexp_extract(line, m, 3)).alias("b"))
    return rows.withColumn("sentence", sentence_of(F.col("kind"), F.col("a"), F.col("b")))


def check_consistency(docs: DataFrame, subclass: DataFrame | None = None, disjoint: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """essayId, consistencyErrors, semanticErrors, sum, feedback, feedback_detail of every document.

    A predicate and its negation are disjoint; ``disjoint`` adds pairs (a, b).
    Statements of ``source`` (one text) come before those of every document.
    Semantic errors are statements against an earlier one; consistency errors
    are subjects that inherit disjoint classes over ``subclass``.
    """
    spark = docs.sparkSession
    rows = triples(docs).withColumn("said", F.lit("essay"))
    if source is not None:
        said = triples(source.limit(1).select(F.lit(0).cast("long").alias("doc_id"), "text")).drop("doc_id")
        ids = docs.select("doc_id").distinct()
        extra = ids.crossJoin(F.broadcast(said)).withColumns({"sent": F.col("sent") - 1_000_000, "said": F.lit("source")})  # one text
        rows = rows.unionByName(extra.select(*rows.columns))
    rows = materialize(rows, "said")  # else each use would read the texts again
    pairs = negations(rows)
    if disjoint is not None:
        pairs = pairs.unionByName(disjoint.select("a", "b"))
    wrong = property_conflicts(rows.drop("said"), pairs).filter("sent >= 0")
    word = F.concat(F.lit("'"), F.concat_ws(" ", "subject", "predicate", "object"), F.lit("' contradicts '"), F.concat_ws(" ", "subject", "with_predicate", "object"), F.lit("'"))
    semantic = wrong.groupBy("doc_id").agg(F.count(F.lit(1)).alias("semanticErrors"), F.array_join(F.array_sort(F.collect_list(F.struct("sent", word.alias("m"))))["m"], "; ").alias("feedback_detail"))
    if subclass is not None and disjoint is not None:
        types = rows.filter(F.col("predicate").isin("is", "are")).select("doc_id", F.col("subject").alias("entity"), F.col("object").alias("class"))
        classes = class_conflicts(types, subclass, disjoint).groupBy("doc_id").agg(F.count(F.lit(1)).alias("consistencyErrors"))
    else:
        classes = spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, consistencyErrors long")
    out = docs.select("doc_id").distinct().join(semantic, "doc_id", "left").join(classes, "doc_id", "left")
    c, s = F.coalesce("consistencyErrors", F.lit(0)).cast("double"), F.coalesce("semanticErrors", F.lit(0)).cast("double")
    text = F.when(c + s > 0, F.concat(F.lit("The text contradicts itself in "), (c + s).cast("int").cast("string"), F.lit(" place(s)."))).otherwise("")
    return out.select(F.col("doc_id").alias("essayId"), c.alias("consistencyErrors"), s.alias("semanticErrors"), (c + s).alias("sum"), text.alias("feedback"), F.coalesce("feedback_detail", F.lit("")).alias("feedback_detail"))


def unresolved(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents without a result yet, to go on after a stop."""
    return docs.join(results.select(F.col("essayId").alias("doc_id")), "doc_id", "left_anti")


def numbered(names: DataFrame) -> DataFrame:
    """(kind, uri, text, ord) of (kind, uri): names by fragment, in falling order of the URI within a kind."""
    order = Window.partitionBy("kind").orderBy(F.desc("uri"))
    return names.distinct().select("kind", "uri", T.camel_words(T.fragment(F.col("uri"))).alias("text"), F.row_number().over(order).alias("ord"))
