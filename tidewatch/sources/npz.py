"""Arrays in zip files: a row for each array, and a table of arrays that grows by appending where a zip file would be written anew."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import keep
from .files import decoded, listing

SCHEMA = "path string, name string, dtype string, shape array<long>, number array<double>, text array<string>"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("number", pa.list_(pa.float64())), ("text", pa.list_(pa.string()))])


def arrays(path: str, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
    """Members one by one; those that are no array, or hold Python objects, are left out."""
    with zipfile.ZipFile(f) as z:
        for member in z.infolist():
            if not member.filename.endswith(".npy"):
                continue
            with z.open(member) as m:
                try:
                    x = np.lib.format.read_array(m, allow_pickle=False)
                except ValueError:
                    continue
            numeric = x.dtype.kind in "fiub"
            flat = x.ravel()
            row = (path, member.filename.removesuffix(".npy"), x.dtype.str, list(x.shape), flat.astype(float) if numeric else None, None if numeric else flat.astype(str).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(row, _ARROW)], schema=_ARROW)


def read(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """Rows of SCHEMA: values in C order, as numbers or else as text."""
    return decoded(listing(spark, path, glob), arrays, SCHEMA)


def append(patches: DataFrame, path: str, batch: int, by: str) -> None:
    """Adds patches (event_id, ...) to a table partitioned by a station: what is there is not read. batch: a number that grows from call to call."""
    patches.withColumn("batch", F.lit(batch).cast("long")).repartition(by).write.mode("append").partitionBy(by).parquet(path)


def latest(spark: SparkSession, path: str, by: str, key: str = "event_id") -> DataFrame:
    """The table with the last patch of each event; of an event twice in a batch any one."""
    w = Window.partitionBy(by, key).orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")


def gridded(arrays: DataFrame, value: str, time: str, lat: str, lon: str) -> DataFrame:
    """A cube (t, y, x) with its times and its grids (y, x), all of one file, to (path, time, lat, lon, value) of valid values, those from 0 to 1."""
    own = keep(arrays.where(F.col("name").isin(value, time, lat, lon)))

    def part(name: str, column: str, alias: str) -> DataFrame:
        return own.where(F.col("name") == name).select("path", "shape", F.posexplode(column).alias("_i", alias))

    cube = part(value, "number", "value").withColumn("_t", F.floor(F.col("_i") / (F.col("shape")[1] * F.col("shape")[2]))).withColumn("_c", F.col("_i") % (F.col("shape")[1] * F.col("shape")[2])).where("value BETWEEN 0 AND 1")
    times = part(time, "text", "time").select("path", F.col("_i").alias("_t"), "time")
    cells = part(lat, "number", "lat").select("path", F.col("_i").alias("_c"), "lat").join(part(lon, "number", "lon").select("path", F.col("_i").alias("_c"), "lon"), ["path", "_c"])
    return cube.join(times, ["path", "_t"]).join(cells, ["path", "_c"]).select("path", "time", "lat", "lon", "value")
