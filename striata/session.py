"""A session with the settings that the toolkit's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Times are UTC; column names are matched by case.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true"}


def configured(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, with these settings and the caller's shuffle partitions; the caller's stays as it is."""
    own = spark.newSession()
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(key, value)
    return own


def session(master: str = "local[*]", app: str = "striata") -> SparkSession:
    return configured(SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
