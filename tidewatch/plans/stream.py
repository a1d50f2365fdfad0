"""The stream of events, read as one, and what it gives out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..shared import shared_folder
from ..ship import ship
from ..sources.tables import table
from ..streaming import sessions
from .registry import plan


def _events(spark, sf):
    """The events' files as a stream, a file at a time."""
    ship(spark)
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("m"), (F.col("user_id") % 6 + 1).cast("string")).alias("mooring"), F.col("value").alias("value"))


def _given_out(stream, to: str):
    """What a stream has given out when all of its input is read."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    q = stream.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/rows")


@plan("""g AS (SELECT mooring, onset_us, CASE WHEN onset_us - lag(onset_us) OVER (PARTITION BY mooring ORDER BY onset_us) < 3600000000 THEN 0 ELSE 1 END AS brk FROM cat),
s AS (SELECT mooring, onset_us, sum(brk) OVER (PARTITION BY mooring ORDER BY onset_us, brk DESC ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT mooring, min(onset_us) AS begin_us, max(onset_us) AS end_us, count(*) AS n FROM s GROUP BY mooring, run HAVING max(onset_us) + 3600000000 <= (SELECT max(onset_us) - 600000000 FROM cat)""")
def st1_gap_sessions(spark, sf):
    """Sessions of each station's stream that the watermark has passed."""
    out = _given_out(sessions.gap_sessions(_events(spark, sf)), f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}")
    return out.select("mooring", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n")
