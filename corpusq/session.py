"""Session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusq", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides single settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
