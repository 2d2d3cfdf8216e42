"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "lathe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` takes names with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def enable_time(spark: SparkSession) -> None:
    """Times of day as a type; sessions made elsewhere have it off."""
    if spark.conf.get("spark.sql.timeType.enabled", "false") != "true":
        spark.conf.set("spark.sql.timeType.enabled", "true")
