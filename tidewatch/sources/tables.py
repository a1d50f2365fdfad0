"""Tables of the star schema, and the views of them in the shapes that the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: event_id, onset_us, mooring, band, event_type, snr, duration_s, end_us, file_number (four hours each)."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    duration = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        "event_id",
        micros("ts").alias("onset_us"),
        F.concat(F.lit("m"), (F.col("user_id") % 6 + 1).cast("string")).alias("mooring"),
        F.when(kind.isin("click", "view"), "low").when(kind == "purchase", "mid").otherwise("high").alias("band"),
        "event_type",
        F.col("value").alias("snr"),
        duration.alias("duration_s"),
        (micros("ts") + (duration * 1000000).cast("long")).alias("end_us"),
        F.floor(micros("ts") / 14400000000).alias("file_number"),
    )
