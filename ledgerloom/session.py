"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, strict arithmetic, names without case: the settings on which results depend.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` has further ones, dots written as double underscores."""
    builder = SparkSession.builder.master(master)
    for k, v in {**SETTINGS, "spark.ui.enabled": "false", **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
