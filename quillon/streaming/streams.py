"""Streams: measures that need one document only, similarity to a frozen corpus, agreement by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import attributes, coherence, content, evaluation


def measures(stream: DataFrame, groups: tuple[str, ...] = attributes.GROUPS, **lists) -> DataFrame:
    """Per-document measures of a stream of (doc_id, text); stateless, so append mode works as it is."""
    return attributes.measures(stream, groups, **lists)


def coherence_measures(stream: DataFrame, size: int, **options) -> DataFrame:
    """Coherence with a frozen window size, as the corpus' mean is not known in a stream."""
    return coherence.coherence(stream, size=size, **options)


def source_similarity(stream: DataFrame, idf: DataFrame, source: DataFrame) -> DataFrame:
    """(doc_id, cosine) to a frozen source vector (term, v), with a frozen (term, idf): stream-static joins in each batch."""
    counts = content.terms(stream)
    raw = counts.join(idf, "term").select("doc_id", "term", (F.col("n") * F.col("idf")).alias("r"))
    norm = raw.join(source, "term", "left").groupBy("doc_id").agg(F.sum(F.col("r") * F.coalesce("v", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return norm.select("doc_id", F.try_divide("dot", "norm").alias("cosine"))


def windowed_agreement(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(start, n, agreement, kappa) by tumbling windows of event time, from (ts, true, predicted); plain sums under a watermark."""
    p, t = F.rint("predicted"), F.col("true")
    timed = stream.withWatermark(ts, late) if stream.isStreaming else stream
    agg = timed.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg((p == t).cast("double")).alias("agreement"), evaluation.kappa(p, t).alias("kappa"))
    return agg.select(F.col("w.start").alias("start"), "n", "agreement", "kappa")
