"""Column-wise scaling of long matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.storage import materialise

#: Moments of so many features are broadcast; the values of more are dealt evenly by feature.
BROADCAST_FEATURES = 100_000


def _with_moments(long: DataFrame) -> DataFrame:
    """Each value with its feature's mean and sd: one partial aggregation, no window over a feature.

    Values meet the moments where they are: a shuffle by feature would bring
    all values of a feature to one task.
    """
    moments = materialise(long.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "moments")
    return long.join(F.broadcast(moments) if moments.count() <= BROADCAST_FEATURES else moments, "feature_id")


def scale(long: DataFrame) -> DataFrame:
    """(sample_id, feature_id, value): centred and divided by the sample sd; null for constant features."""
    sd = F.when(F.col("sd") != 0, F.col("sd"))
    return _with_moments(long).select("sample_id", "feature_id", ((F.col("value") - F.col("mean")) / sd).alias("value"))


def center(long: DataFrame) -> DataFrame:
    return _with_moments(long).select("sample_id", "feature_id", (F.col("value") - F.col("mean")).alias("value"))


def ranked(long: DataFrame) -> DataFrame:
    """Values replaced by their average ranks within the feature."""
    from pyspark.sql import Window as W

    counts = long.groupBy("feature_id", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("feature_id").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranks = counts.select("feature_id", "value", (upto - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    return long.join(ranks, ["feature_id", "value"]).select("sample_id", "feature_id", F.col("rank").alias("value"))
