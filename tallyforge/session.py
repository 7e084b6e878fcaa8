"""Spark session of the bench and the tests; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **overrides: str) -> SparkSession:
    """Session on one machine; ``overrides`` uses ``__`` for the dots of a key."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
    }
    settings |= {key.replace("__", "."): value for key, value in overrides.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyforge")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
