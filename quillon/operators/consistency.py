"""The consistency run as one flow: seeds, resolution, growth of the ontology, guarded insertion, feedback sentences.

Ontology tables: ``nodes`` (kind, uri, text, stem, ord) with kinds ``SubObj``
and ``Pred``; ``subclass`` (child, parent); ``disjoint`` (a, b) of classes or
of properties; ``lexicon`` (word, relation, other) as in
:func:`quillon.operators.graph.lexical_edges`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.stem import clean_phrase, stemmed
from quillon.operators import attributes, graph
from quillon.sources.staging import materialize, small

NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS", "CD", "PRP$")
VERB_TAGS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD", "RB")


def _runs(tokens, tags, wanted: tuple[str, ...], must: tuple[str, ...]):
    """The longest runs of tokens with wanted tags that hold one of ``must``: phrases, in order.

    Tokens become one string with control characters for the ends of tokens and
    runs and for what a run must hold, so the cost is linear in the sentence.
    """
    word = lambda p: F.concat(F.when(p["t"].isin(*must), F.lit("\x02")).otherwise(""), F.translate(p["w"], "\x01\x02\x03", ""))
    marked = F.transform(F.arrays_zip(tokens.alias("w"), tags.alias("t")), lambda p: F.when(p["t"].isin(*wanted), word(p)).otherwise("\x03"))
    runs = F.filter(F.split(F.array_join(marked, "\x01"), "\x03"), lambda r: F.contains(r, F.lit("\x02")))
    return F.transform(runs, lambda r: F.trim(F.translate(r, "\x01\x02", " ")))


def chunks(docs: DataFrame, tagger=attributes.rule_tags) -> DataFrame:
    """(doc_id, sent, kind, original): noun and verb phrases of every sentence by runs of tags; ``tagger`` maps tokens to tags.

    No shuffle and no Python: each sentence is one expression.
    """
    parts = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence"))
    said = parts.select("doc_id", "sent", T.tokens(F.col("sentence")).alias("tokens")).withColumn("tags", tagger(F.col("tokens")))
    nouns = _runs(F.col("tokens"), F.col("tags"), NOUN_TAGS, ("NN", "NNS", "NNP", "NNPS"))
    verbs = _runs(F.col("tokens"), F.col("tags"), VERB_TAGS, VERB_TAGS[:6])
    of = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("original")))
    both = F.concat(of("SubObj", nouns), of("Pred", verbs))
    return said.select("doc_id", "sent", F.explode(both).alias("c")).select("doc_id", "sent", "c.kind", "c.original")


def normalised(mentions: DataFrame, column: str = "original") -> DataFrame:
    """``mentions`` with ``text`` (the phrase cleaned) and ``stem``; the different phrases are cleaned once each."""
    own = mentions.select(column).distinct().withColumn("text", clean_phrase(F.col(column)))
    own = own.withColumn("stem", F.array_join(stemmed(F.split("text", " ")), " "))
    return mentions.join(own, column)


def seeds(docs: DataFrame, nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """(kind, uri, text, stem, original): the entities a run starts with.

    A chunk that is near a node of its kind names that node; nodes that no chunk
    names follow under their own text, with ``original`` null.
    """
    named = normalised(chunks(docs).select("kind", "original").distinct()).filter("text <> ''")
    parts = []
    for kind in ("SubObj", "Pred"):
        near = graph.fuzzy_links(named.filter(F.col("kind") == kind).select("text"), nodes.filter(F.col("kind") == kind), least)
        parts.append(named.filter(F.col("kind") == kind).join(near.select("text", "uri"), "text").select("kind", "uri", "text", "stem", "original"))
    met = parts[0].unionByName(parts[1])
    rest = nodes.join(met.select("kind", "uri").distinct(), ["kind", "uri"], "left_anti")
    return met.unionByName(rest.select("kind", "uri", "text", "stem", F.lit(None).cast("string").alias("original")))


def resolve(mentions: DataFrame, nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """(kind, text, stem, uri, how) of every different mention (kind, text, stem).

    The first that succeeds: equal text, equal stem, near text, near stem; each
    gives the node of least ``ord``.  ``uri`` and ``how`` are null if none does.
    """
    own = mentions.select("kind", "text", "stem").distinct()
    exact = nodes.groupBy("kind", "text").agg(F.min_by("uri", "ord").alias("by_text"))
    equal = nodes.groupBy("kind", "stem").agg(F.min_by("uri", "ord").alias("by_stem"))
    out = own.join(exact, ["kind", "text"], "left").join(equal, ["kind", "stem"], "left")
    left = out.filter("by_text IS NULL AND by_stem IS NULL")
    for column in ("text", "stem"):
        near = [
            graph.fuzzy_links(left.filter(F.col("kind") == k).select(F.col(column).alias("text")), nodes.filter(F.col("kind") == k).select("uri", "ord", F.col(column).alias("text")), least)
            .select(F.lit(k).alias("kind"), F.col("text").alias(column), F.col("uri").alias(f"near_{column}"))
            for k in ("SubObj", "Pred")
        ]
        out = out.join(near[0].unionByName(near[1]), ["kind", column], "left")
    ways = ("by_text", "by_stem", "near_text", "near_stem")
    how = F.coalesce(*[F.when(F.col(w).isNotNull(), w) for w in ways])
    return out.select("kind", "text", "stem", F.coalesce(*ways).alias("uri"), how.alias("how"))


def add_elements(mentions: DataFrame, nodes: DataFrame, lexicon: DataFrame | None = None, base: str = "#", least: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolve mentions (kind, text, stem), attach what is unknown and relate it: (elements, below, against).

    ``elements`` is (kind, text, uri, how): a known node, the first known synonym
    (``synonym``), or a new name under ``base``: a class or a property name.
    ``below`` is (kind, child, parent) of new names under their first known
    hypernym; ``against`` (kind, a, b), both ways, of new names and known
    antonyms, and of a new predicate with ``not`` and the known or new one that it denies.
    """
    found = materialize(resolve(mentions, nodes, least), "resolved")
    fresh = F.concat(F.lit(base), F.when(F.col("kind") == "Pred", T.property_name(F.col("text"))).otherwise(T.class_name(F.col("text"))))
    found = found.withColumn("fresh", fresh)
    below, against, same = [], [], []
    if lexicon is not None:
        for kind in ("SubObj", "Pred"):
            new = found.filter((F.col("kind") == kind) & F.col("uri").isNull()).select(F.col("text").alias("word"), "fresh")
            s, up, anti = graph.lexical_edges(new.select("word"), nodes.filter(F.col("kind") == kind), lexicon)
            tag = F.lit(kind).alias("kind")
            same.append(s.select(tag, F.col("word").alias("text"), F.col("uri").alias("synonym")))
            below.append(up.join(new.select(F.col("word").alias("child"), "fresh"), "child").select(tag, F.col("fresh").alias("child"), "parent"))
            against.append(anti.join(new.select(F.col("word").alias("a"), "fresh"), "a").select(tag, F.col("fresh").alias("a"), "b"))
        found = found.join(same[0].unionByName(same[1]), ["kind", "text"], "left")
    else:
        found = found.withColumn("synonym", F.lit(None).cast("string"))
    how = F.coalesce("how", F.when(F.col("synonym").isNotNull(), "synonym"), F.lit("new"))
    elements = found.select("kind", "text", F.coalesce("uri", "synonym", "fresh").alias("uri"), how.alias("how"))
    preds = elements.filter("kind = 'Pred'")
    positive = preds.select(F.col("text").alias("positive"), F.col("uri").alias("b")).unionByName(nodes.filter("kind = 'Pred'").select(F.col("text").alias("positive"), F.col("uri").alias("b")))
    first = positive.groupBy("positive").agg(F.min("b").alias("b"))
    denied = preds.filter("text LIKE 'not %'").select(F.col("uri").alias("a"), F.expr("substring(text, 5)").alias("positive")).join(first, "positive").select(F.lit("Pred").alias("kind"), "a", "b")
    empty = mentions.sparkSession.createDataFrame([], "kind string, child string, parent string")
    pairs = reduce(DataFrame.unionByName, against, denied)
    turned = pairs.unionByName(pairs.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    return elements, reduce(DataFrame.unionByName, below, empty).filter("child <> parent").distinct(), turned


def adjective_classes(rows: DataFrame, subclass: DataFrame, tagger=attributes.rule_tags) -> tuple[DataFrame, DataFrame]:
    """Objects of adjectives and a noun that the subject is below: (stated, below).

    ``stated`` says the adjectives of the subject with the row's predicate, below
    (doc_id, sent, child, parent) puts it under ``adjective noun``.  The noun is the last one.
    """
    kinds = graph.closure(subclass).select(F.col("child").alias("subject"), F.col("parent").alias("noun"))
    tokens = F.split("object", " ")
    pairs = F.arrays_zip(tokens.alias("w"), F.col("tags").alias("t"))
    of = lambda *tags: F.transform(F.filter("pairs", lambda p: p["t"].isin(*tags)), lambda p: p["w"])
    said = rows.withColumn("tags", tagger(tokens)).withColumn("pairs", pairs)
    said = said.withColumn("noun", F.try_element_at(of("NN", "NNS", "NNP", "NNPS"), F.lit(-1))).withColumn("adjective", F.explode(of("JJ", "JJR", "JJS")))
    hit = said.join(kinds, ["subject", "noun"], "left_semi")
    stated = hit.select("doc_id", "sent", "subject", "predicate", F.col("adjective").alias("object"))
    return stated, hit.select("doc_id", "sent", F.col("subject").alias("child"), F.concat_ws(" ", "adjective", "noun").alias("parent"))


def special_classes(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, sent, child, parent): ``s is o`` also puts s under o where the sentence's first entity is no person.

    ``entities`` is (doc_id, sent, pos, type), as a recogniser gives them.
    """
    first = entities.groupBy("doc_id", "sent").agg(F.min_by("type", "pos").alias("type")).filter("type <> 'PERSON'")
    typed = rows.filter(F.col("predicate").isin("is", "are", "be"))
    return typed.join(first, ["doc_id", "sent"], "left_semi").select("doc_id", "sent", F.col("subject").alias("child"), F.col("object").alias("parent"))


def matching(rows: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """Triples that fit a pattern; a part that is None fits all."""
    wanted = {"subject": subject, "predicate": predicate, "object": obj}
    return rows.filter(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v is not None], F.lit(True)))


def statement_index(asked: DataFrame, stated: DataFrame) -> DataFrame:
    """(doc_id, subject, predicate, object, sent): the least sentence that speaks of all three parts, null if none does.

    ``stated`` is (doc_id, sent, subject, predicate, object).  A predicate ``is``
    or ``type`` says nothing of a sentence, so there the other two decide.
    Documents follow each other in sorted partitions, what is stated before what
    is asked.  A question looks only at the sentences of that part of it which
    the document speaks of least.
    """
    keys = ["doc_id", "subject", "predicate", "object"]
    number = stated.schema["sent"].dataType.simpleString()
    both = stated.select(*keys, "sent", F.lit(False).alias("asks")).unionByName(asked.select(*keys, F.lit(None).cast(number).alias("sent"), F.lit(True).alias("asks")))
    ordered = both.repartition("doc_id").sortWithinPartitions("doc_id", "asks", "subject", "predicate", "object")
    types = dict(ordered.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "sent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, last = None, None
        named: dict[str, set[int]] = {}
        said: dict[str, set[int]] = {}
        for batch in batches:
            rows, found = [], []
            for i, (d, s, p, o, sent, asks) in enumerate(zip(*[batch.column(c).to_pylist() for c in [*keys, "sent", "asks"]], strict=True)):
                if d != doc:
                    doc, named, said = d, {}, {}
                if not asks:
                    if d is not None and sent is not None:
                        for table, name in ((named, s), (said, p), (named, o)):
                            if name is not None:
                                table.setdefault(name, set()).add(sent)
                elif last != (d, s, p, o):
                    last = (d, s, p, o)
                    where = [named.get(s, ()), named.get(o, ())] + ([] if p in ("is", "type") else [said.get(p, ())])
                    least, *others = sorted(where, key=len)
                    rows.append(i)
                    found.append(min((x for x in least if all(x in y for y in others)), default=None))
            yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(rows, pa.int64())).columns, pa.array(found, batch.schema.field("sent").type)], names=[*keys, "sent"])

    return ordered.mapInArrow(run, schema)


def opposing(rejected: DataFrame, stated: DataFrame, properties: DataFrame, subclass: DataFrame, classes: DataFrame) -> DataFrame:
    """The statement that speaks against a rejected one: ``rejected`` with (with_predicate, with_object), null if none is found.

    Statements of the same subject with the first disjoint property: about the
    object's farthest ancestor, then the object, then its farthest descendant.
    Without a disjoint property, the first class disjoint with the object.
    """
    rival = graph.symmetric(properties).groupBy(F.col("a").alias("predicate")).agg(F.min("b").alias("rival"))
    up = graph.closure(subclass)
    reach = (
        rejected.select(F.col("object"), F.col("object").alias("about"), F.lit(0).alias("side"), F.lit(0).alias("steps")).distinct()
        .unionByName(up.select(F.col("child").alias("object"), F.col("parent").alias("about"), F.lit(-1).alias("side"), "steps"))
        .unionByName(up.select(F.col("parent").alias("object"), F.col("child").alias("about"), F.lit(1).alias("side"), "steps"))
    )
    keys = ["doc_id", "sent", "subject", "predicate", "object"]
    said = stated.select("doc_id", "subject", F.col("predicate").alias("rival"), F.col("object").alias("about")).distinct()
    own = rejected.select(*keys).distinct().join(rival, "predicate", "left")
    # Of one distance the least name is taken.
    rank = F.struct("side", (-F.col("steps")).alias("far"), "about", F.col("rival").alias("by"))
    met = own.join(reach, "object").join(said, ["doc_id", "subject", "rival", "about"]).groupBy(*keys).agg(F.min(rank).alias("m"))
    other = graph.symmetric(classes).groupBy(F.col("a").alias("object")).agg(F.min("b").alias("class"))
    out = own.join(met, keys, "left").join(other, "object", "left")
    by_class = F.col("rival").isNull()
    return out.select(*keys, F.when(by_class & F.col("class").isNotNull(), F.col("predicate")).otherwise(F.col("m.by")).alias("with_predicate"), F.when(by_class, F.col("class")).otherwise(F.col("m.about")).alias("with_object"))


def feedback_sentences(opposed: DataFrame, sentences: DataFrame, stated: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent, feedback) of rejected statements with what speaks against them (:func:`opposing`).

    ``sentences`` is (doc_id, sent, sentence), ``source`` (sent, sentence) of the
    source text, whose statements ``stated`` holds with negative numbers -1, -2, ...
    for its first, second, ... sentence.  A statement of the ontology alone is
    put into words.
    """
    keys = ["doc_id", "subject", "with_predicate", "with_object"]
    asked = opposed.filter("with_object IS NOT NULL").select("doc_id", "subject", F.col("with_predicate").alias("predicate"), F.col("with_object").alias("object"))
    where = statement_index(asked, stated).select("doc_id", "subject", F.col("predicate").alias("with_predicate"), F.col("object").alias("with_object"), F.col("sent").alias("at"))
    out = opposed.join(where, keys, "left").join(sentences.select("doc_id", F.col("sent"), F.col("sentence").alias("own")), ["doc_id", "sent"], "left")
    out = out.join(sentences.select("doc_id", F.col("sent").alias("at"), F.col("sentence").alias("other")), ["doc_id", "at"], "left")
    if source is not None:
        out = out.join(source.select((-1 - F.col("sent")).alias("at"), F.col("sentence").alias("from_source")), "at", "left")
    else:
        out = out.withColumn("from_source", F.lit(None).cast("string"))
    words = F.concat(F.initcap("subject"), F.lit(" "), F.col("with_predicate"), F.lit(" "), F.col("with_object"), F.lit("'."))
    against = F.coalesce(F.concat("other", F.lit("'.")), F.concat("from_source", F.lit("' (from source text).")), words)
    plain = F.concat(F.lit("Relation '"), F.concat_ws(" ", "subject", "predicate", "object"), F.lit("' is inconsistent with a relation in ontology."))
    return out.select("doc_id", "sent", F.when(F.col("with_object").isNull(), plain).otherwise(F.concat(F.lit("Relation '"), F.col("own"), F.lit("' is inconsistent with a relation in ontology: '"), against)).alias("feedback"))


def guarded(rows: DataFrame, subclass: DataFrame, classes: DataFrame, properties: DataFrame, turbo: bool = True) -> DataFrame:
    """``rows`` (doc_id, sent, step, kind, subject, predicate, object) with ``kept`` and ``error``, inserted one by one.

    Within a sentence the additions of its elements come first (kind ``axiom``,
    predicate ``type`` or ``subclass``), then its statements (``triple``;
    predicate ``type`` for ``is``), by ``step``.  What would make the ontology
    inconsistent is left out: an entity under two disjoint classes, or a
    statement beside one of a disjoint property about the same subject and the
    same object, an ancestor or a descendant of it.  ``error`` is
    ``consistency`` for axioms and ``semantic`` for triples.

    With ``turbo`` additions go in unchecked, and only a sentence whose triples
    fail is taken back and replayed with every check, so errors of axioms count
    only there; without it every addition is checked at once.  What a sentence
    that passes has added unchecked stays, and never counts against a later
    one by itself.

    Documents follow each other in sorted partitions, a sentence at a time, so a
    document's state, and not its rows, is what a task holds.  What the ontology
    says of a name is one string next to the row, read once for each name.
    """
    every_name = rows.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    names = materialize(every_name.filter("name IS NOT NULL"), "names")
    up = graph.closure(subclass, names).groupBy(F.col("child").alias("name")).agg(F.collect_set("parent").alias("above"))
    rival = graph.symmetric(properties).groupBy(F.col("a").alias("name")).agg(F.to_json(F.collect_set("b")).alias("rivals"))
    apart = graph.symmetric(classes).groupBy(F.col("a").alias("name")).agg(F.collect_set("b").alias("apart"))
    # A name and its ancestors, with the classes each is disjoint with.
    every = names.join(up, "name", "left").select("name", F.explode(F.array_union(F.array("name"), F.coalesce("above", F.array().cast("array<string>")))).alias("one"))
    met = every.join(apart.withColumnRenamed("name", "one"), "one", "left").groupBy("name").agg(F.collect_set("one").alias("line"), F.array_distinct(F.flatten(F.collect_list("apart"))).alias("apart"))
    known = small(materialize(met.select("name", F.to_json(F.struct("line", "apart")).alias("known")), "known"))
    own = ["doc_id", "sent", "step", "kind", "subject", "predicate", "object"]
    out = rows.select(*own).join(small(materialize(rival.withColumnRenamed("name", "predicate"), "rivals")), "predicate", "left")
    for c in ("subject", "object"):
        out = out.join(known.withColumnsRenamed({"name": c, "known": f"{c}_known"}), c)
    order = [F.asc_nulls_last(c) for c in ("sent", "step", "subject", "predicate", "object")]
    out = out.select(*own, "rivals", "subject_known", "object_known").repartition("doc_id").sortWithinPartitions("doc_id", *order)
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in own], "kept boolean", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, _State()
        waiting: list[pa.RecordBatch] = []  # rows whose sentence may go on
        sentence: list[_Row] = []
        verdicts: list[str | None] = []
        for batch in batches:
            waiting.append(batch)
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "sent", "kind", "subject", "predicate", "object", "rivals", "subject_known", "object_known")]
            for doc, sent, *rest in zip(*columns, strict=True):
                if last is None or last != (doc, sent):
                    verdicts += state.insert(sentence, turbo)
                    sentence = []
                    if last is None or last[0] != doc:
                        state.clear()
                    last = (doc, sent)
                # Without a number a row is in no sentence, and stays.
                sentence.append(_Row(*rest)) if sent is not None else verdicts.append(None)
            yield from _decided(waiting, verdicts, own)
        verdicts += state.insert(sentence, turbo)
        yield from _decided(waiting, verdicts, own)

    return out.mapInArrow(run, schema)


def _decided(waiting: list[pa.RecordBatch], verdicts: list[str | None], own: list[str]) -> Iterator[pa.RecordBatch]:
    """The first rows of ``waiting``, as many as there are verdicts; both lists keep the rest."""
    if not verdicts:
        return
    n = len(verdicts)
    table = pa.Table.from_batches(waiting)
    done = table.select(own).slice(0, n).append_column("kept", pa.array([v is None for v in verdicts], pa.bool_())).append_column("error", pa.array(verdicts, pa.string()))
    verdicts.clear()
    waiting[:] = table.slice(n).to_batches()
    yield from done.combine_chunks().to_batches()


class _Row(NamedTuple):
    kind: str
    subject: str
    predicate: str
    object: str
    rivals: str | None
    subject_known: str
    object_known: str


class _State:
    """What a document has said so far, with a journal to take a sentence back; what the ontology says outlasts documents."""

    #: Most names whose place in the ontology is kept between documents.
    NAMES = 100_000

    def __init__(self) -> None:
        self.near: dict[str, frozenset[str]] = {}  # name -> itself and its ancestors in the ontology
        self.apart: dict[str, frozenset[str]] = {}  # class -> classes that it or an ancestor is disjoint with
        self.against: dict[str, tuple[str, ...]] = {}
        self.clear()

    def clear(self) -> None:
        """A new document begins."""
        if len(self.near) > self.NAMES:
            self.near, self.apart = {}, {}
        self.lines: dict[str, dict[str, int]] = {}  # entity -> its classes, with how many additions named each
        self.parents: dict[str, dict[str, int]] = {}
        self.said: dict[tuple[str, str], dict[str, int]] = {}
        self.seen: set[str] = set()  # names the document has used
        self.journal: list[tuple[dict, str]] = []

    def insert(self, sentence: list[_Row], turbo: bool) -> list[str | None]:
        """The errors of a sentence's rows, None for those that stay."""
        if turbo:
            mark = len(self.journal)
            for r in sentence:
                if r.kind == "triple" and not self.allows(r):
                    self.back_to(mark)
                    break
                self.add(r)
            else:
                return [None] * len(sentence)
        out: list[str | None] = []
        for r in sentence:
            if self.allows(r):
                self.add(r)
                out.append(None)
            else:
                out.append("semantic" if r.kind == "triple" else "consistency")
        return out

    def back_to(self, mark: int) -> None:
        while len(self.journal) > mark:
            table, key = self.journal.pop()
            table[key] -= 1
            if not table[key]:
                del table[key]

    def _learn(self, r: _Row) -> None:
        for name, known in ((r.subject, r.subject_known), (r.object, r.object_known)):
            if name not in self.near:
                found = json.loads(known)
                self.near[name], self.apart[name] = frozenset(found["line"]), frozenset(found.get("apart") or ())
            self.seen.add(name)

    def _over(self, name: str) -> frozenset[str]:
        """The classes a name is under by the document's own words, and those above them."""
        if not self.parents and name in self.seen:
            return self.near[name]  # closed upwards
        seen, todo = set(), [name]
        while todo:
            one = todo.pop()
            if one not in seen:
                seen.add(one)
                todo += self.parents.get(one, ())
                if one in self.seen:
                    todo += self.near[one]
        return frozenset(seen)

    def _apart(self, names: frozenset[str]) -> set[str]:
        return {b for c in names if c in self.seen for b in self.apart[c]}

    def allows(self, r: _Row) -> bool:
        self._learn(r)
        if r.predicate in ("type", "subclass") and not self.parents:
            # What a name is disjoint with counts for all that is under it, so both ends of a line decide.
            apart, subject = self.apart[r.object], r.subject
            for c in (r.object, subject, *self.lines.get(subject, ())):
                if not self.near[c].isdisjoint(apart):
                    return False
            for name, classes in self.lines.items():
                if name != subject and any(subject in self.near[c] for c in classes) and not all(self.near[c].isdisjoint(apart) for c in (name, *classes)):
                    return False
            return True
        if r.predicate in ("type", "subclass"):
            above = self._over(r.object)
            apart = self._apart(above)
            # All that is below the subject comes under the object too.
            below = {r.subject} | {n for n in self.parents if r.subject in self._over(n)}
            for name in below | {e for e, cs in self.lines.items() if any(not below.isdisjoint(self._over(c)) for c in cs)}:
                now = self._over(name).union(*(self._over(c) for c in self.lines.get(name, ())))
                if not now.isdisjoint(apart) or not above.isdisjoint(self._apart(now)):
                    return False
            return above.isdisjoint(apart)
        if r.rivals is None:
            return True
        if r.rivals not in self.against:
            self.against[r.rivals] = tuple(json.loads(r.rivals))
        line = self._over(r.object)
        for rival in self.against[r.rivals]:
            for other in self.said.get((r.subject, rival), ()):
                if other in line or r.object in self._over(other):
                    return False
        return True

    def add(self, r: _Row) -> None:
        self._learn(r)
        if r.predicate == "subclass":
            table = self.parents.setdefault(r.subject, {})
        elif r.predicate == "type":
            table = self.lines.setdefault(r.subject, {})
        else:
            table = self.said.setdefault((r.subject, r.predicate), {})
        table[r.object] = table.get(r.object, 0) + 1
        self.journal.append((table, r.object))


def error_counts(inserted: DataFrame, docs: DataFrame) -> DataFrame:
    """essayId, consistencyErrors, semanticErrors, sum of every document, in the order of the ids."""
    count = lambda e: F.count_if(F.col("error") == e)
    agg = inserted.groupBy("doc_id").agg(count("consistency").alias("c"), count("semantic").alias("s"))
    c, s = F.coalesce("c", F.lit(0)), F.coalesce("s", F.lit(0))
    out = docs.select("doc_id").distinct().join(agg, "doc_id", "left")
    return out.select(F.col("doc_id").alias("essayId"), c.alias("consistencyErrors"), s.alias("semanticErrors"), (c + s).alias("sum")).orderBy("essayId")


def run(docs: DataFrame, nodes: DataFrame, subclass: DataFrame, classes: DataFrame, properties: DataFrame, lexicon: DataFrame | None = None, source: DataFrame | None = None, turbo: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole flow: (counts, feedback) of :func:`error_counts` and :func:`feedback_sentences`.

    Statements are extracted, pronouns resolved, parts resolved against ``nodes``
    and seeds, unknown ones attached by ``lexicon``; adjectives add their
    statements; then everything is inserted under guard.  ``source`` (one text)
    speaks before every document, its sentences numbered -1, -2, ...; a document
    gets what is said there of the subjects and objects that it names itself.
    Each step is written once to the shared folder, so no step is made twice.
    """
    said = graph.resolve_pronouns(graph.triples(docs))
    sentences = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence"))
    heard = None
    if source is not None:
        one = source.limit(1).select(F.lit(0).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "text")
        heard = one.select(F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence"))
        first = graph.resolve_pronouns(graph.triples(one)).withColumn("sent", -1 - F.col("sent"))
        said = said.unionByName(first)
    said = materialize(said, "said")
    adjectives, below_adjective = adjective_classes(said, subclass)
    said = said.unionByName(adjectives)
    names = materialize(normalised(
        said.select(F.lit("SubObj").alias("kind"), F.explode(F.array("subject", "object")).alias("original"))
        .unionByName(said.select(F.lit("Pred").alias("kind"), F.col("predicate").alias("original"))).distinct()
    ), "names")
    known = nodes.unionByName(
        seeds(docs, nodes).filter("original IS NOT NULL").join(nodes.select("kind", "uri", "ord"), ["kind", "uri"]).select(*nodes.columns)
    ).distinct()
    known = materialize(known, "known")
    # Statement predicates keep "is" as the type and "not" before the denied predicate.
    elements, below, against = add_elements(names.filter("original NOT IN ('is', 'are', 'be')"), known, lexicon)
    elements, below, against = materialize(elements, "elements"), materialize(below, "below"), materialize(against, "against")
    uris = names.select("kind", "original", "text").join(elements, ["kind", "text"]).select("kind", "original", "uri")
    out = said.withColumn("step", F.lit(1)).withColumn("kind", F.lit("triple"))
    for c, kind in (("subject", "SubObj"), ("predicate", "Pred"), ("object", "SubObj")):
        of = uris.filter(F.col("kind") == kind).select(F.col("original").alias(c), F.col("uri").alias(f"{c}_uri"))
        out = out.join(of, c, "left")
    is_type = F.col("predicate").isin("is", "are", "be")
    rows = out.select(
        "doc_id", "sent", "step", "kind", F.coalesce("subject_uri", "subject").alias("subject"),
        F.when(is_type, "type").otherwise(F.coalesce("predicate_uri", "predicate")).alias("predicate"), F.coalesce("object_uri", "object").alias("object"),
    )
    axioms = below_adjective.select("doc_id", "sent", F.lit(0).alias("step"), F.lit("axiom").alias("kind"), F.col("child").alias("subject"), F.lit("subclass").alias("predicate"), F.col("parent").alias("object"))
    every = rows.unionByName(axioms).filter(F.lower("subject") != F.lower("object"))
    if source is not None:
        # What the source says goes to the documents that name its subject.
        own = every.filter("sent >= 0")
        named = own.select("doc_id", F.explode(F.array("subject", "object")).alias("subject")).distinct()
        every = own.unionByName(every.filter("sent < 0").drop("doc_id").join(named, "subject").select(*own.columns))
    under = subclass.select("child", "parent").unionByName(below.filter("kind = 'SubObj'").select("child", "parent")).distinct()
    split = lambda kind: against.filter(F.col("kind") == kind).select("a", "b")
    disjoint, rivals = classes.select("a", "b").unionByName(split("SubObj")), properties.select("a", "b").unionByName(split("Pred"))
    # The source's sentences come first: -1, -2, ... before 0.
    turned = F.when(F.col("sent") < 0, -1_000_000_000 - F.col("sent")).otherwise(F.col("sent"))
    done = guarded(every.withColumn("sent", turned), under, disjoint, rivals, turbo)
    done = done.withColumn("sent", F.when(F.col("sent") < 0, -1_000_000_000 - F.col("sent")).otherwise(F.col("sent")))
    done = materialize(done, "inserted")
    wrong = done.filter("error = 'semantic' AND sent >= 0")
    kept = done.filter("kept")
    fits = opposing(wrong, kept, rivals, under, disjoint)
    return error_counts(done.filter("sent >= 0"), docs), feedback_sentences(fits, sentences, kept, heard)
