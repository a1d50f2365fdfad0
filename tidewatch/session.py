"""A session with the settings that the engine expects; everything else is left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidewatch", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in more.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
