"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution on; other settings by keyword, with _ for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
