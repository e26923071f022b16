"""Spark sessions with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time zone for comparable timestamps; adaptive execution for skewed joins and small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS and ``conf``; the master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map={**DEFAULTS, **conf}).getOrCreate()
