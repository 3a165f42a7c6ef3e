"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "karst", **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC and no speculation (model calls are not idempotent in cost)."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.speculation": "false",
        "spark.scheduler.mode": "FAIR",  # the server's endpoints have a pool each
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
