"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``docs``.

In all stages every row is a document, whether its doc_id is repeated or null;
extra columns are kept, whatever their names; and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, mixing, quality, sharding, simhash
from quillon.llm._common import materialize, remove, scope, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null, empty and blank texts have no features, so the bias alone decides on
    all of them alike; equal texts share their fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least doc_id, null ids last.

    Null, empty and blank texts are copies of each other.
    """
    return simhash.dedup_similar(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, verbatim or edited, go; null, empty and blank texts hold none."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them; those without words once for each epoch, at least once."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that their virtual slot is mapped to; a null text counts as empty."""
    return sharding.assign(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Training, fingerprints and alignment have no form in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote on the way is removed once its result is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        remove(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
