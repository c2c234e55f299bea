"""Session settings that the operators assume: ANSI arithmetic, adaptive execution, UTC."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "spindrift", **settings: str) -> SparkSession:
    """Get or make a session.  Keyword names use ``__`` for the dots of Spark's settings."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
