from pyspark.sql import functions as F

from quillon.operators import attributes as A
from quillon.operators import graph, selection


def test_row_numbers_have_no_gap_on_many_files(spark, tmp_path):
    """More rows a file than a range exchange samples."""
    path = str(tmp_path / "rows")
    spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("doc_id"), F.lit(1).alias("part"), F.lit("x").alias("place")).repartition(16).write.parquet(path)
    rows = spark.read.parquet(path)
    out = selection.row_index(rows, "doc_id")
    assert out.columns == [*rows.columns, "idx"]
    got = out.agg(F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()
    assert tuple(got) == (300_000, 300_000, 0, 299_999)
    from pyspark.sql import Window

    falls = out.withColumn("before", F.lag("doc_id").over(Window.partitionBy(F.floor(F.col("idx") / 1000)).orderBy("idx"))).filter("before >= doc_id")
    assert falls.count() == 0
    sizes = {r["fold"]: r["count"] for r in selection.folds(rows, "doc_id", even=True).groupBy("fold").count().collect()}
    assert sizes == {i: 30_000 for i in range(10)}


def test_closure_of_long_paths_and_cycles(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(230)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")]
    got = {(r["child"], r["parent"]): r["steps"] for r in graph.closure(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got["n000", "n230"] == 230 and len(got) == 230 * 231 // 2 + 6
    assert got["a", "b"] == 1 and got["a", "c"] == 2 and got["b", "a"] == 2
    assert graph.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_dictionary_of_syllables_and_heads(spark):
    docs = spark.createDataFrame([(1, "Fire fire, hello brave world!", [[2, 0, 2], [0]]), (2, None, None), (3, "", [])], "doc_id long, text string, heads array<array<int>>")
    known = spark.createDataFrame([("fire", 2), ("fire", 1), ("world", 1)], "word string, syllables int")
    got = {r["doc_id"]: r["syllables"] for r in A.dictionary_syllables(docs, known).collect()}
    assert got == {1: 1 + 1 + 2 + 1 + 1, 2: 0, 3: 0}
    heights = {r["doc_id"]: r["sentenceStructureTreeHeight"] for r in A.measures(docs, ("grammar",), heads="heads").collect()}
    assert heights == {1: 1.5, 2: None, 3: None}
