"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from .ship import ship


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a temporary folder where it names none and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tidewatch-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs no recomputation of what came before."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()
