"""Mixing sources to target weights, in DataFrame functions.

Each row gets a hash-random key; rows of a source are range-partitioned by the
key into buckets, bucket sums give distributed prefix sums of the word counts,
and each source is cut at its exact budget.  A budget above the source's size
repeats whole epochs first; the remainder is a prefix of the next epoch in key
order, and the one document across the cut gives its leading words only.

Only the bucket across the cut (1/``N_BUCKETS`` of a source) is ordered row by
row, so a source holding a third of all rows needs no large task.  The texts
never shuffle.

Defined cases: a null text has size 0 and is taken 0 times.  A null source is
a source of its own, after all others.  Rows equal in id share a key and are
ordered by size; rows equal in both are interchangeable, and counted as a group
before anything is ordered, so that an id that very many rows share does not
meet in a task.  An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD_RE, materialize, small, table, unused

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Hexadecimal digits of the key that name its bucket.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """A hash of the id as text: the same in every run."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    ``weights`` repeat over the sources by code point, null last.  Water
    filling in closed form: sources sorted by how soon they reach their cap;
    those before the first one that stays within its cap are capped, the rest
    share what is left by weight.  One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    w = source_sizes.withColumn("w", F.element_at(cyc, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    soonest = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto = soonest.rowsBetween(Window.unboundedPreceding, -1)
    onward = soonest.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy(F.lit(1))
    w = (
        w.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(onward))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everyone))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return w.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``slim`` (doc_id, source, size) with source_size, target, taken and bucket order.

    ``slim`` should be materialised: it is read three times.
    """
    keyed = slim.withColumn("key", random_key(F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = materialize(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bytes")), "mix-buckets")
    goal = targets(buckets.groupBy("source").agg(F.sum("bytes").alias("source_size")), weights, max_repeat)
    goal = goal.withColumn("budget", F.floor(F.col("target")).cast("long")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("budget"), F.col("source_size")))).otherwise(0).cast("long")
    )
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = buckets.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    cut = (
        sums.alias("s").join(goal.alias("g"), same)
        .filter((F.col("s.start") <= F.col("g.rest")) & (F.col("g.rest") < F.col("s.start") + F.col("s.bytes")))
        .select(F.col("s.source").alias("c_source"), F.col("s.bucket").alias("c_bucket"), F.col("s.start").alias("c_start"))
    )
    info = goal.join(cut, goal["source"].eqNullSafe(cut["c_source"]), "left").drop("c_source").withColumnRenamed("source", "i_source")
    info = small(materialize(info, "mix-info"))  # one row a source, so that a source with many rows stays spread
    rows = keyed.join(info, keyed["source"].eqNullSafe(F.col("i_source"))).drop("i_source")
    at_cut = F.col("bucket") == F.col("c_bucket")
    edge = rows.filter(at_cut)
    # Equal rows are summed before they are ordered; of their group the cut takes ``room`` words.
    groups = edge.groupBy("source", "key", "size", "c_start", "rest").agg(F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("c_start") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(inner), F.lit(0))
    room = F.least(F.col("n") * F.col("size"), F.greatest(F.lit(0), F.col("rest") - prefix))
    groups = materialize(groups.select(F.col("source").alias("g_source"), F.col("key").alias("g_key"), F.col("size").alias("g_size"), "n", room.alias("room")), "mix-edges")
    edge = edge.join(small(groups), F.col("source").eqNullSafe(F.col("g_source")) & (F.col("key") == F.col("g_key")) & (F.col("size") == F.col("g_size")))
    divided = (F.col("n") > 1) & (F.col("room") > 0) & (F.col("room") < F.col("n") * F.col("size"))
    full = F.when(F.col("size") > 0, F.expr("room div size")).otherwise(F.lit(0))
    share = F.when(divided, full / F.col("n")).otherwise(F.lit(1.0))
    if groups.filter((F.col("n") > 1) & (F.col("room") > 0) & (F.col("room") < F.col("n") * F.col("g_size"))).take(1):
        edge = edge.withColumn("place", F.lit(0).cast("long"))
        edge = edge.filter(~divided).unionByName(_places(edge.filter(divided).drop("place")))
        part = F.when(~divided, F.least("size", "room")).when(F.col("place") < full, F.col("size")).when(F.col("place") == full, F.col("room") - full * F.col("size")).otherwise(F.lit(0))
    else:
        part = F.when(F.col("n") > 1, F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0))).otherwise(F.col("room"))
    columns = [*rows.columns, "part", "share"]
    edge = edge.withColumn("part", part).withColumn("share", share).select(*columns)
    whole = rows.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("part", F.when(F.col("bucket") < F.col("c_bucket"), F.col("size")).otherwise(F.lit(0)))
    planned = whole.withColumn("share", F.lit(1.0)).select(*columns).unionByName(edge)
    return planned.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def _places(rows: DataFrame) -> DataFrame:
    """``rows``, all those of a source equal, with ``place``: 0, 1, ... within the source, numbered where they lie and shifted by the counts before."""
    lying = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-equal").withColumn("lot", F.shiftright("uid", 33))
    counts = lying.groupBy("source", "lot").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("source").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select(F.col("source").alias("l_source"), F.col("lot").alias("l_lot"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start")), "mix-lots")
    own = F.row_number().over(Window.partitionBy("source", "lot").orderBy("uid")) - 1
    numbered = lying.withColumn("own", own).join(small(starts), F.col("source").eqNullSafe(F.col("l_source")) & (F.col("lot") == F.col("l_lot")))
    return numbered.withColumn("place", (F.col("start") + F.col("own")).cast("long")).drop("uid", "lot", "own", "l_source", "l_lot", "start")


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row."""
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    return plan(materialize(slim, "mix-slim"), weights, max_repeat).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them, whole texts only.

    A row comes once for each full epoch, and once more if the cut of the last
    epoch leaves it at least half (rows without words: once for each epoch, at
    least once).  Of rows equal in id and size across the cut, about their share
    comes.  Rows keep their place: the plan needs no join with the texts,
    as a row's share follows from its key and its source's cut; only cuts (one
    row a source and, for the bucket across the cut, its last whole row) are joined.
    """
    slim = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "mix-slim")
    planned = plan(slim, weights, max_repeat)
    half = (F.col("size") > 0) & (2 * F.col("part") >= F.col("size"))
    last = planned.groupBy("source").agg(
        F.max("epochs").alias("epochs"), F.max(F.when(half, F.struct("key", "size", "share"))).alias("last")
    )
    source, key, size, epochs, edge, lot = unused(docs, "m_source", "m_key", "m_size", "m_epochs", "m_last", "m_lot")
    # One row a source: the texts stay where they are unless there are more sources than may be broadcast.
    cuts = small(materialize(last.select(F.col("source").alias(source), F.col("epochs").alias(epochs), F.col("last").alias(edge)), "mix-cuts"))
    base = docs.withColumns({key: random_key(F.col("doc_id")), size: n_words(F.col("text")), lot: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)})
    joined = base.join(cuts, base["source"].cast("string").eqNullSafe(cuts[source]), "left")
    # Of equal rows that the cut divides, a share is drawn: they can't be told apart.
    own, end = F.struct(F.col(key), F.col(size)), F.struct(F.col(edge)["key"], F.col(edge)["size"])
    inside = F.coalesce((own < end) | ((own == end) & (F.col(lot) < F.col(edge)["share"])), F.lit(False)).cast("int")
    copies = F.when(F.col(size) > 0, F.col(epochs) + inside).otherwise(F.greatest(F.lit(1), F.col(epochs)))
    times = F.explode(F.sequence(F.lit(1), copies.cast("int")))
    return joined.filter(copies > 0).select(*[F.col(f"`{c}`") for c in docs.columns], times.alias(size)).drop(size)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
             CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM z),
l AS (SELECT *, ((SELECT sum(source_size) FROM z)::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
m AS (SELECT source, source_size, least(cap, coalesce((SELECT max(lv) FILTER (lv * w <= cap) FROM l) * w, cap)) AS target FROM l),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM m),
p AS (SELECT s.*, g.source_size, g.target, g.epochs, g.budget - g.epochs * g.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, rest - prefix)) AS BIGINT) AS taken FROM p
"""
