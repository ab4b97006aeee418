"""Readers and writers: essays, source texts, word lists, ontologies, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.functions import text as T

FEEDBACK = StructType(
    [
        StructField("essayId", DoubleType()), StructField("consistencyErrors", DoubleType()), StructField("semanticErrors", DoubleType()),
        StructField("sum", DoubleType()), StructField("feedback", StringType()), StructField("feedback_detail", StringType()),
    ]
)


def essays(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Tab-separated essays with a header; rows that are short get nulls.

    With a schema no pass over the file is spent on inference.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def source_text(spark: SparkSession, path: str) -> DataFrame:
    """(text,) of a file that must hold exactly one line that is not blank."""
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "text")
    if len(rows.take(2)) != 1:
        raise ValueError(f"{path}: a source text is one line")
    return rows


def first_text(df: DataFrame | None, column: str) -> DataFrame | None:
    """The one text of a table, or None if there is no table or no row."""
    if df is None:
        return None
    one = df.select(F.col(column).alias("text")).limit(1)
    return one if one.take(1) else None


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word,) lower case and distinct, of a file with a word a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def _unescaped(literal: Column) -> Column:
    """A literal without its escapes of backslashes, quotes and line ends."""
    out = F.replace(literal, F.lit("\\\\"), F.lit("\x01"))
    out = F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\x01"), F.lit("\\"))


def triples_file(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, kind) of N-Triples; ``kind`` tells URI objects from literals. Comments and blank nodes go."""
    m = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)")\S*\s*\.\s*$'
    rows = spark.read.text(path).filter(F.col("value").rlike(m))
    part = lambda i: F.regexp_extract("value", m, i)
    uri = part(3) != ""
    return rows.select(part(1).alias("s"), part(2).alias("p"), F.when(uri, part(3)).otherwise(_unescaped(part(4))).alias("o"), F.when(uri, "uri").otherwise("literal").alias("kind"))


def ontology_xml(spark: SparkSession, path: str, row_tag: str = "owl:Class") -> DataFrame:
    """(s, p, o, kind) of one kind of element of RDF/XML: its name, superclasses and disjoint classes; files of any size split by element."""
    link = "array<struct<`_rdf:resource` string>>"
    schema = f"`_rdf:about` string, `rdfs:subClassOf` {link}, `rdfs:subPropertyOf` {link}, `owl:disjointWith` {link}, `owl:propertyDisjointWith` {link}"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    edges = lambda n: F.transform(f"`{n}`", lambda x: F.struct(F.lit(n).alias("p"), x["_rdf:resource"].alias("o")))
    parts = [edges(n) for n in ("rdfs:subClassOf", "rdfs:subPropertyOf", "owl:disjointWith", "owl:propertyDisjointWith")]
    typed = F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit(row_tag).alias("o")))
    flat = rows.filter("`_rdf:about` is not null").select(F.col("`_rdf:about`").alias("s"), F.explode(F.flatten(F.filter(F.array(typed, *parts), lambda x: x.isNotNull()))).alias("e"))
    return flat.select("s", "e.p", "e.o", F.lit("uri").alias("kind")).filter("o is not null").distinct()


def ontology_names(triples: DataFrame, comments: bool = False) -> DataFrame:
    """(kind, uri): subjects and objects as ``SubObj``, predicates as ``Pred``; comment triples are left out unless asked for."""
    rows = triples if comments else triples.filter(~F.col("p").endswith("rdf-schema#comment"))
    both = rows.select(F.col("s").alias("uri")).unionByName(rows.filter("kind = 'uri'").select(F.col("o").alias("uri")))
    return both.withColumn("kind", F.lit("SubObj")).unionByName(rows.select(F.col("p").alias("uri")).withColumn("kind", F.lit("Pred"))).distinct().select("kind", "uri")


def write_ontology(triples: DataFrame, path: str) -> None:
    """Triples (s, p, o, kind) as N-Triples, one file a partition; :func:`triples_file` reads them back."""
    literal = F.regexp_replace(F.regexp_replace("o", r"([\\\"])", r"\\$1"), r"\n", r"\\n")
    last = F.when(F.col("kind") == "uri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), literal, F.lit('"')))
    triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), last, F.lit(" .")).alias("value")).write.mode("overwrite").text(path)


def write_measures(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_summary(results: DataFrame, path: str) -> None:
    """Tab-separated id, consistency errors, semantic errors, sum."""
    whole = [F.col(c).cast("long").alias(c) for c in ("essayId", "consistencyErrors", "semanticErrors", "sum")]
    results.select(*whole).write.mode("overwrite").option("sep", "\t").csv(path)


def write_feedback(results: DataFrame, path: str) -> None:
    """A folder for each essay with its feedback text."""
    results.select("essayId", F.concat_ws("\n", "feedback", "feedback_detail").alias("value")).write.mode("overwrite").partitionBy("essayId").text(path)


def default_lexicon(spark: SparkSession) -> DataFrame:
    """(word,) of the built-in stop words and easy words."""
    return spark.createDataFrame([(w,) for w in sorted({*T.STOPWORDS, *T.EASY_WORDS})], "word string")
