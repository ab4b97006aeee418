"""Entry points: attributes of essays, scores of predictions, consistency, and SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import attributes as A
from quillon.operators import coherence as C
from quillon.operators import content as V
from quillon.operators import evaluation, graph

GROUPS = ("BasicMeasures", "ReadabilityMeasures", "LexicalDiversity", "Grammar", "Content", "Coherence")
_LOCAL = {"BasicMeasures": "basic", "ReadabilityMeasures": "readability", "LexicalDiversity": "lexical", "Grammar": "grammar"}
CONTENT = (
    "numberOfSpellcheckingErrors", "numberOfCapitalizationErrors", "numberOfPunctuationErrors", "cosineWithSourceText",
    "scoreCosineSimilarityMax", "cosineTopEssaySimilarityAverage", "cosinePattern", "cosineSumOfCorrelationValues",
)


def content_measures(essays: DataFrame, grades: DataFrame | None = None, graded: DataFrame | None = None, source: DataFrame | None = None, lexicon: DataFrame | None = None, names: tuple[str, ...] = CONTENT) -> DataFrame:
    """doc_id and the content measures.

    ``grades`` is (doc_id, grade) of ``graded`` (the essays themselves by
    default).  The similarity stage is planned only if a measure needs it.
    """
    from quillon.sources import tables

    spark = essays.sparkSession
    out = essays.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", A.capitalization_errors(F.col("text")).cast("double").alias("numberOfCapitalizationErrors"), A.punctuation_errors(F.col("text")).cast("double").alias("numberOfPunctuationErrors")
    )
    if "numberOfSpellcheckingErrors" in names:
        spelled = A.spelling_errors(A.prepare(essays), lexicon if lexicon is not None else tables.default_lexicon(spark))
        out = out.join(spelled.withColumn("numberOfSpellcheckingErrors", F.col("numberOfSpellcheckingErrors").cast("double")), "doc_id", "left")
    similar = [n for n in CONTENT[4:] if n in names and grades is not None]
    if similar or ("cosineWithSourceText" in names and source is not None):
        rows = essays.select("doc_id", "text")
        if graded is not None:
            rows = rows.unionByName(graded.select("doc_id", "text"))
        if source is not None:
            # A number below all ids stands for the source text.
            kind, key = dict(rows.dtypes)["doc_id"], -1
            if kind != "string":
                key = min(key, (rows.agg(F.min("doc_id")).first()[0] or 0) - 1)
            rows = rows.unionByName(source.limit(1).select(F.lit(key).cast(kind).alias("doc_id"), "text"))
        weights = V.tfidf(V.terms(rows)).cache()
        if source is not None:
            out = out.join(V.cosine_with(weights, key).withColumnRenamed("cosine", "cosineWithSourceText"), "doc_id", "left")
        own = weights.filter(F.col("doc_id") != key) if source is not None else weights
        if "scoreCosineSimilarityMax" in similar:
            out = out.join(V.nearest(own, grades).select("doc_id", "scoreCosineSimilarityMax"), "doc_id", "left")
        if "cosineTopEssaySimilarityAverage" in similar:
            out = out.join(V.top_similarity(own, grades), "doc_id", "left")
        if {"cosinePattern", "cosineSumOfCorrelationValues"} & set(similar):
            out = out.join(V.pattern(V.similarity_by_grade(own, grades)), "doc_id", "left")
    return out.select("doc_id", *[n for n in CONTENT if n in names and n in out.columns])


def attributes(essays: DataFrame, groups: tuple[str, ...] = GROUPS, grades: DataFrame | None = None, graded: DataFrame | None = None, source: DataFrame | None = None, names: list[str] | None = None, **options) -> DataFrame:
    """A wide row of measures for each essay, in the order of ``groups``; ``score`` comes last if the essays are graded."""
    out, ordered = essays.select("doc_id"), []
    local = tuple(_LOCAL[g] for g in groups if g in _LOCAL)
    if local:
        out = A.measures(essays, local, **options)
    for g in groups:
        if g == "Content":
            part = content_measures(essays, grades, graded, source)
        elif g == "Coherence":
            part = C.coherence(essays)
        else:
            ordered += list(A.group(_LOCAL[g]))
            continue
        ordered += part.columns[1:]
        out = out.join(part, "doc_id", "left")
    wanted = [n for n in ordered if names is None or n in names]
    columns = [F.col(f"`{n}`") for n in wanted]
    if grades is not None and graded is None:
        out = out.join(grades.select("doc_id", F.col("grade").cast("double").alias("score")), "doc_id", "left")
        columns.append(F.col("score"))
    return out.select("doc_id", *columns)


def table_attributes(essays: DataFrame, key: str, text: str, **options) -> DataFrame:
    """:func:`attributes` of a table as read: the grade is the column that :func:`evaluation.detect_grade` finds, if it finds one."""
    own = essays.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    grade = evaluation.detect_grade(essays, key)
    grades = essays.select(F.col(key).alias("doc_id"), F.col(grade).alias("grade")) if grade else None
    return attributes(own, grades=grades, **options)


def score_predictions(df: DataFrame, true: str = "score", predicted: str | None = None, fold: str = "fold") -> DataFrame:
    return evaluation.score_predictions(df, true, evaluation.choose_columns(df, predicted), fold)


check_consistency = graph.check_consistency

#: Functions to call from SQL: name, arguments, body.
SQL_FUNCTIONS = (
    ("essay_tokens", "x STRING", f"regexp_extract_all(lower(coalesce(x, '')), r'{T.TOKEN_RE}', 0)"),
    ("essay_sentences", "x STRING", f"filter(transform(regexp_extract_all(coalesce(x, ''), r'{T.SENTENCE_RE}', 0), s -> regexp_replace(s, r'^\\s+|\\s+$', '')), s -> s <> '')"),
    ("essay_words", "x STRING", "size(filter(essay_tokens(x), t -> t rlike r'[\\p{L}\\p{N}_]'))"),
)


def register_sql(spark: SparkSession) -> list[str]:
    """Temporary SQL functions for use in queries; they expand in the plan, so no Python runs."""
    for name, args, body in SQL_FUNCTIONS:
        kind = "INT" if name == "essay_words" else "ARRAY<STRING>"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return [n for n, *_ in SQL_FUNCTIONS]


def lemmatized(token_array: Column, lemmas: dict[str, str]) -> Column:
    """Tokens replaced by a table of lemmas (a plug-in; without one tokens stay); the table becomes part of the plan, so it must be short."""
    table = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair])
    return F.transform(token_array, lambda t: F.coalesce(F.element_at(table, t), t))
