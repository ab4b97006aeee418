"""Folds, models, ranks and selection of measures on Spark ML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import evaluation
from quillon.sources.staging import materialize

#: Ranges of a hash-free key order that are numbered apart before their counts are added.
RANGES = 64


def row_index(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``idx``, its place (from 0) by ``key``: ranges are numbered apart, then shifted by the counts before them.

    The ranged rows are written once with the number of their range: a range
    exchange draws its bounds from a sample, so made twice it would deal rows
    out in two ways.  No window runs over the whole table.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    part, place, n, start = (name + "_" * max(map(len, df.columns)) for name in ("part", "place", "n", "start"))  # longer than any column's name
    ranged = materialize(df.repartitionByRange(RANGES, key).withColumn(part, F.spark_partition_id()), "ranged")
    local = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(key)))
    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n))  # at most RANGES rows
    starts = sizes.select(part, F.coalesce(F.sum(n).over(order), F.lit(0)).alias(start))
    return local.join(F.broadcast(starts), part).select(*columns, (F.col(start) + F.col(place) - 1).alias("idx"))


def folds(df: DataFrame, key: str, k: int = 10, even: bool = False) -> DataFrame:
    """``df`` with ``fold``: runs of floor(n / k) rows by ``key``.

    Rows left over get fold k, which is never tested; with ``even`` the first
    n % k folds take one more instead.
    """
    n = df.count()
    chunk, extra = n // k, n % k
    rows = row_index(df, key)
    i = F.col("idx")
    if even:
        wide = extra * (chunk + 1)
        fold = F.when(i < wide, F.floor(i / (chunk + 1))).otherwise(extra + F.floor((i - wide) / F.lit(max(chunk, 1))))
    else:
        fold = F.least(F.floor(i / F.lit(max(chunk, 1))), F.lit(k)) if chunk else F.lit(k)
    return rows.withColumn("fold", fold.cast("int")).drop("idx")


def model(kind: str, features: str = "features", label: str = "grade", n: int | None = None, alpha: float = 0.02, trees: int = 100):
    """``forest``, ``ridge`` (penalty alpha on the sum of squares, so alpha / n here) or ``linear``."""
    if kind == "forest":
        return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=trees, seed=0)
    penalty = alpha / n if kind == "ridge" and n else 0.0
    return LinearRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0, regParam=penalty, standardization=False)


def assemble(df: DataFrame, names: list[str], scale: bool = False) -> DataFrame:
    """Missing values are 0; optionally scaled to [0, 1]."""
    filled = df.na.fill(0.0, names)
    out = VectorAssembler(inputCols=names, outputCol="raw" if scale else "features").transform(filled)
    return MinMaxScaler(inputCol="raw", outputCol="features").fit(out).transform(out).drop("raw") if scale else out


def cross_predict(df: DataFrame, names: list[str], kind: str = "linear", k: int = 10, grade: str = "grade") -> DataFrame:
    """(doc_id, true, predicted, fold): each fold predicted by a model of the others, kept within the grades' range."""
    data = assemble(df, names).select("doc_id", "features", F.col(grade).cast("double").alias("grade"), "fold").cache()
    top = data.agg(F.max("grade")).first()[0]
    out = None
    for i in range(k):
        test, train = data.filter(F.col("fold") == i), data.filter(F.col("fold") != i)
        if not test.take(1):
            continue
        fitted = model(kind, n=train.count()).fit(train)
        part = fitted.transform(test).select("doc_id", F.col("grade").alias("true"), F.least(T.clip_prediction(F.col("prediction")), F.lit(top)).alias("predicted"), "fold")
        out = part if out is None else out.unionByName(part)
    return out


def cv_kappa(df: DataFrame, names: list[str], kind: str = "linear", k: int = 10) -> float:
    row = cross_predict(df, names, kind, k).groupBy("fold").agg(evaluation.kappa(F.rint("predicted"), F.col("true")).alias("q")).agg(F.avg("q")).first()
    return row[0] if row[0] is not None else 0.0


def forward(df: DataFrame, names: list[str], score: Callable[[list[str]], float] | None = None, patience: int = 20, backward: bool = False, kind: str = "linear") -> tuple[list[str], float]:
    """Greedy selection: keep a measure if the score grows; stop after ``patience`` tries without; optionally drop again what is not missed."""
    measure = score or (lambda chosen: cv_kappa(df, chosen, kind))
    chosen, best, failed = [], float("-inf"), 0
    for name in names:
        value = measure([*chosen, name])
        if value > best:
            chosen, best, failed = [*chosen, name], value, 0
        else:
            failed += 1
            if failed >= patience:
                break
    if backward:
        for name in list(chosen):
            rest = [n for n in chosen if n != name]
            if rest and (value := measure(rest)) >= best:
                chosen, best = rest, value
    return chosen, best


def f_scores(df: DataFrame, names: list[str], grade: str = "grade") -> DataFrame:
    """(name, f): F statistic of each measure's correlation with the grade; one aggregate for all."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("n"), *[F.corr(F.col(f"`{c}`"), F.col(grade)).alias(f"c{i}") for i, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{i}").alias("r")) for i, c in enumerate(names)])
    flat = row.select("n", F.explode(pairs).alias("p")).select("n", "p.*")
    r2 = F.col("r") * F.col("r")
    return flat.select("name", F.try_divide(r2 * (F.col("n") - 2), 1 - r2).alias("f"))


def best(scores: DataFrame, k: int = 65, value: str = "f") -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(value), "name").limit(k)


def mean_ranks(ranks: DataFrame) -> DataFrame:
    """(name, rank): the mean over folds of :func:`average_ranks`, from the best on."""
    return ranks.groupBy("name").agg(F.avg("rank").alias("rank")).orderBy("rank", "name")


def average_ranks(weights: DataFrame, value: str = "weight", by: str = "fold") -> DataFrame:
    """(fold, name, rank): 1 for the largest weight, ties share the mean of their ranks. One row a measure and fold."""
    w = Window.partitionBy(by)
    rank = F.rank().over(w.orderBy(F.desc(value)))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, value))
    return weights.select(by, "name", (rank + (ties - 1) / 2).alias("rank"))


def ridge_weights(df: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """(fold, name, weight): size of each measure's ridge coefficient with one fold left out."""
    data = assemble(df, names).withColumn("grade", F.col("grade").cast("double")).cache()
    rows = []
    for i in range(k):
        train = data.filter(F.col("fold") != i)
        fitted = model("ridge", n=train.count()).fit(train)
        rows += [(i, n, float(abs(c))) for n, c in zip(names, fitted.coefficients.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "fold int, name string, weight double")


def eliminate(df: DataFrame, names: list[str], keep: int = 30) -> list[str]:
    """Recursive elimination: drop the measure with the least ridge coefficient until ``keep`` are left."""
    left = list(names)
    n = df.count()
    while len(left) > keep:
        data = assemble(df, left).withColumn("grade", F.col("grade").cast("double"))
        weights = model("ridge", n=n).fit(data).coefficients.toArray()
        left.pop(int(abs(weights).argmin()))
    return left


def forest_importance(df: DataFrame, names: list[str], most: int = 90, trees: int = 50) -> list[str]:
    """Measures of at least mean importance, the most important first, at most ``most``."""
    data = assemble(df, names).withColumn("grade", F.col("grade").cast("double"))
    weights = model("forest", trees=trees).fit(data).featureImportances.toArray()
    order = sorted(range(len(names)), key=lambda i: (-weights[i], names[i]))
    return [names[i] for i in order if weights[i] >= weights.mean()][:most]


def votes(chosen: DataFrame, least: int = 2) -> DataFrame:
    """Measures chosen in at least ``least`` folds, from (fold, name)."""
    return chosen.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a random order that every run repeats."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
