"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of a side that is broadcast; beyond either, the join shuffles.
SMALL = 500_000
SMALL_BYTES = 64 << 20

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a single-machine session may go without that setting; there a new
    temporary folder serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    folder = tempfile.mkdtemp(prefix="quillon-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    for made in _scopes[-1:]:
        made.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives lost executors: the rows are files in shared
    storage, not blocks of one executor.  The schema is passed on, so an empty
    result reads back too.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Paths given out within it, to :func:`remove` once nothing reads them."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _width(df: DataFrame) -> Column:
    """Bytes of a row's strings, binaries and arrays; all else counts as 8."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array"):
            size += 8 * F.greatest(F.size(c), F.lit(0))
        else:
            size += 8
    return size


def small(df: DataFrame, rows: int = SMALL, most: int = SMALL_BYTES) -> DataFrame:
    """``df``, which should be materialised, marked for broadcast if its rows and bytes, counted, are few."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df
