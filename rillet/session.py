"""Sessions with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "rillet", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans and skew handling; ``conf`` has the last word."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=own | conf).getOrCreate()
