"""Agreement of predicted with true grades; everything is sums, so partial and final aggregation apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(a: Column, b: Column) -> Column:
    """Quadratic weighted kappa of two columns of ratings, as one aggregate; null if all ratings are equal.

    The weights' scale and the expected matrix cancel to
    1 - sum((a - b)^2) / (sum(a^2) + sum(b^2) - 2 sum(a) sum(b) / n).
    """
    a, b = a.cast("int").cast("double"), b.cast("int").cast("double")
    apart = F.sum(F.pow(a - b, F.lit(2)))
    chance = F.sum(a * a) + F.sum(b * b) - 2 * F.sum(a) * F.sum(b) / F.count(F.lit(1))
    return F.when(F.abs(chance) > 1e-12, 1 - F.try_divide(apart, chance))


def by_fold(predictions: DataFrame, true: str = "true", predicted: str = "predicted", fold: str = "fold") -> DataFrame:
    """(fold, n, agreement, closeness, kappa) for each fold, and for all with fold null: one ROLLUP.

    ``closeness`` is 1 less the mean absolute difference; it may be negative.
    """
    p, t = F.rint(F.col(predicted)), F.col(true)
    return predictions.rollup(fold).agg(
        F.grouping(fold).alias("is_total"),
        F.count(F.lit(1)).alias("n"),
        F.avg((p == t).cast("double")).alias("agreement"),
        (1 - F.avg(F.abs(p - t))).alias("closeness"),
        kappa(p, t).alias("kappa"),
    )


def score_predictions(predictions: DataFrame, true: str = "true", predicted: str = "predicted", fold: str = "fold") -> DataFrame:
    """One row: exactAgreement, weightedKappa, exactAgreementFolds, weightedKappaFolds, to 5 places."""
    rows = by_fold(predictions, true, predicted, fold)
    whole, each = F.col("is_total") == 1, F.col("is_total") == 0
    return rows.agg(
        F.round(F.max(F.when(whole, F.col("agreement"))), 5).alias("exactAgreement"),
        F.round(F.max(F.when(whole, F.col("kappa"))), 5).alias("weightedKappa"),
        F.round(F.avg(F.when(each, F.col("closeness"))), 5).alias("exactAgreementFolds"),
        F.round(F.avg(F.when(each, F.col("kappa"))), 5).alias("weightedKappaFolds"),
    )


def confusion(predictions: DataFrame, true: str = "true", predicted: str = "predicted") -> DataFrame:
    t, p = F.col(true).cast("int").alias("true"), F.rint(F.col(predicted)).cast("int").alias("predicted")
    return predictions.groupBy(t, p).agg(F.count(F.lit(1)).alias("n"))


def histogram(predictions: DataFrame, rating: str = "true") -> DataFrame:
    return predictions.groupBy(F.col(rating).cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))


def choose_columns(df: DataFrame, predicted: str | None = None) -> str:
    """The prediction column: the one asked for, else ``Random Forest``, else ``Linear Regression``."""
    for name in (predicted, "Random Forest", "Linear Regression"):
        if name in df.columns:
            return name
    raise ValueError("no prediction column")


def detect_grade(df: DataFrame, order_by: str) -> str | None:
    """The last numeric column, the first one left out, whose value in the first row is a number."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint")
    numeric = [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")][1:]
    first = df.orderBy(order_by).select(*numeric).first() if numeric else None
    good = [n for n in numeric if first is not None and first[n] is not None and float(first[n]) == float(first[n])]
    return good[-1] if good else None
