from pyspark.sql import functions as F

from quillon.operators import evaluation
from quillon.plans import api
from quillon.sources import tables
from quillon.streaming import streams


def essays(spark):
    texts = ["Cats chase mice in old barns. Mice hide.", "Dogs chase cats in new barns.", "Birds sing songs at dawn.", "Cats and dogs sleep at dawn."]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_all_attributes(spark):
    grades = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 3)], "doc_id long, grade int")
    source = spark.createDataFrame([("Cats chase mice.",)], "text string")
    out = api.attributes(essays(spark), grades=grades, source=source)
    assert len(out.columns) == 1 + 104 + 1 and out.columns[-1] == "score"
    assert api.attributes(essays(spark), grades=grades).columns.count("cosineWithSourceText") == 0
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 4 and rows[0]["cosineWithSourceText"] > rows[2]["cosineWithSourceText"]


def test_some_attributes(spark):
    out = api.attributes(essays(spark), ("BasicMeasures",), names=["numberOfWords"])
    assert out.columns == ["doc_id", "numberOfWords"]


def test_sql_functions(spark):
    assert set(api.register_sql(spark)) == {"essay_tokens", "essay_sentences", "essay_words"}
    row = spark.sql("SELECT essay_tokens('A b, c'), essay_words('A b, c'), essay_sentences('One. Two!')").first()
    assert row[0] == ["a", "b", ",", "c"] and row[1] == 3 and row[2] == ["One.", "Two!"]


def test_readers(spark, tmp_path):
    (tmp_path / "e.tsv").write_text('id\tessay\tgrade\tmore\n1\t"A b\tc."\t3.5\n2\tD.\t4\t5\n')
    df = tables.essays(spark, str(tmp_path / "e.tsv"))
    assert df.count() == 2 and df.filter("id = 1").first()["essay"] == "A b\tc."
    assert evaluation.detect_grade(df, "id") == "grade"
    (tmp_path / "s.txt").write_text("One line.\n")
    assert tables.source_text(spark, str(tmp_path / "s.txt")).first()["text"] == "One line."
    (tmp_path / "w.txt").write_text("The\nthe\n\nDog")
    assert {r[0] for r in tables.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"the", "dog"}
    (tmp_path / "o.nt").write_text('<http://x#A> <http://x#p> <http://x#B> .\n<http://x#A> <http://w3/rdf-schema#comment> "c" .\n# note\n')
    triples = tables.triples_file(spark, str(tmp_path / "o.nt"))
    names = tables.ontology_names(triples)
    assert {(r["kind"], r["uri"]) for r in names.collect()} == {("SubObj", "http://x#A"), ("SubObj", "http://x#B"), ("Pred", "http://x#p")}


def test_streams_equal_batches(spark, tmp_path):
    essays(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = streams.measures(stream, ("basic",)).writeStream.format("memory").queryName("measured").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    from quillon.operators import attributes

    assert sorted(map(tuple, spark.table("measured").collect())) == sorted(map(tuple, attributes.measures(essays(spark), ("basic",)).collect()))


def test_agreement_by_event_time(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, 1.2), ("2024-01-01 00:20:00", 2, 0.9), ("2024-01-01 02:00:00", 1, 1.0)], "ts string, true int, predicted double")
    rows = rows.withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_agreement(stream).writeStream.outputMode("append").format("memory").queryName("agreed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # The watermark closes the first hour only.
    assert [(r["n"], r["agreement"]) for r in spark.table("agreed").collect()] == [(2, 0.5)]
    assert streams.windowed_agreement(rows).count() == 2


def test_the_source_text_takes_no_id_of_an_essay(spark):
    docs = spark.createDataFrame([(-1, "Cats chase mice."), (-2, "Birds sing songs.")], "doc_id long, text string")
    source = spark.createDataFrame([("Cats chase mice.",)], "text string")
    rows = {r["doc_id"]: r["cosineWithSourceText"] for r in api.content_measures(docs, source=source, names=("cosineWithSourceText",)).collect()}
    assert round(rows[-1], 9) == 1 and rows[-2] == 0


def test_ontology_comes_back(spark, tmp_path):
    rows = [("http://x#A", "http://x#p", "http://x#B", "uri"), ("http://x#A", "http://x#c", "one \"word\"\nand a \\n", "literal")]
    tables.write_ontology(spark.createDataFrame(rows, "s string, p string, o string, kind string"), str(tmp_path / "o"))
    assert {tuple(r) for r in tables.triples_file(spark, str(tmp_path / "o")).collect()} == set(rows)


def test_lemmas_of_sentences(spark):
    from quillon.functions import text as T

    lemmas = F.create_map(F.lit("dogs"), F.lit("dog"), F.lit("bark"), F.lit("bark"))
    row = spark.range(1).select(T.lemmatized_sentences(F.array(F.lit("dogs barking."), F.lit("No.")), lemmas).alias("a"), T.lemmatized_sentences(F.array(F.lit("dogs barking.")), lemmas, strip_ing=True).alias("b")).first()
    assert row["a"] == ["dog barking ."] and row["b"] == ["dog bark ."]


def test_grade_of_a_table_is_found(spark):
    table = spark.createDataFrame([(1, "A b c.", 3.5, None), (2, "D e.", 4.0, 5.0)], "id int, essay string, grade double, more double")
    out = api.table_attributes(table, "id", "essay", groups=("BasicMeasures",))
    assert {r["doc_id"]: r["score"] for r in out.collect()} == {1: 3.5, 2: 4.0} and len(out.columns) == 16


def test_mean_ranks_over_folds(spark):
    from quillon.operators import selection

    rows = [(0, "a", 1.0), (1, "a", 4.0), (0, "b", 2.0), (1, "b", 1.0)]
    assert [tuple(r) for r in selection.mean_ranks(spark.createDataFrame(rows, "fold int, name string, rank double")).collect()] == [("b", 1.5), ("a", 2.5)]
