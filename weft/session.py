"""A session with the settings this library is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "weft", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew-join splitting, UTC, Arrow transfer; conf overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
