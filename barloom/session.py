"""The Spark session and its settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans skewed joins and small partitions; times are naive, so UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def make_session(name: str = "barloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; others are passed with _ for . in their names."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
