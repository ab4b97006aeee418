"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.staging import SMALL, materialize, new_path, remove, scope, shared_dir, small

__all__ = ["SMALL", "WORD_RE", "materialize", "new_path", "own_numbers", "remove", "scope", "shared_dir", "small", "table", "unused"]

#: A word is a maximal run of anything but U+0020 and U+0009..U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df``, which should be materialised, with the hash ``name`` changed where different ``key`` share it, so that each has its own."""
    attempt = 0
    while True:
        shared = materialize(df.groupBy(name).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(name), "clashes")
        if not shared.take(1):
            return df
        shared = df.join(F.broadcast(shared), name).groupBy(name).agg(F.min(key).alias("first"))
        attempt += 1
        joined = df.join(F.broadcast(shared), name, "left")
        other = F.when(F.col("first").isNotNull() & (F.col(key) != F.col("first")), F.xxhash64(F.lit(attempt), key)).otherwise(F.col(name))
        df = materialize(joined.withColumn(name, other).select(*df.columns), "numbered")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores appended until no column of ``df`` has it (columns compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
