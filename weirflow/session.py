"""The Spark session that pipelines run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on (time zone, ANSI errors), and those that let Spark re-plan as it runs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "weirflow", master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one. Settings are given with underscores for dots or as a **dict."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key if "." in key else key.replace("_", "."), value)
    return builder.getOrCreate()
