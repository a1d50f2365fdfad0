"""Hydrophone recordings: a 256-byte big-endian header and unsigned 16-bit big-endian samples around 32768.

Files are listed through the session's file system, and each is opened by the task that reads it: 256 bytes for a header, pieces of samples as Arrow
arrays. A file of four hours is the smallest parallel unit of detection, as causal filters carry state through it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import decoded, listing, opened

HEADER = 256
ZERO = 32768.0
#: Places of the header's fields.
_TEXT = {"instrument_id": (0x40, 0x48), "project": (0x88, 0x98), "firmware": (0x98, 0xA5), "hardware_serial": (0xD9, 0xE3), "daq_serial": (0xE8, 0xF6)}
_NUMBERS = {"sample_rate": (">I", 0xC4), "adc_bytes": (">B", 0xC9), "lowpass_hz": (">H", 0xCC), "active_seconds": (">I", 0xD0), "duty_cycle_seconds": (">I", 0xD4)}
_TIME = (0x58, 0x78)
_FIELDS = [*_TEXT, *_NUMBERS]
HEADER_SCHEMA = "path string, file_number int, timestamp timestamp, " + ", ".join([*(f"{k} string" for k in _TEXT), *(f"{k} int" for k in _NUMBERS)])


def _text(b: bytes) -> str:
    return b.replace(b"\0", b"").decode("ascii").strip()


def header_time(raw: str) -> datetime:
    """ "YYY DDD:HH:MM:SS:mmm", the years since 1900."""
    year, rest = raw.split()
    day, hour, minute, second, ms = map(int, rest.split(":"))
    return datetime(1900 + int(year), 1, 1) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second, milliseconds=ms)


def read_header(content: bytes) -> dict:
    out: dict = {"timestamp": header_time(_text(content[slice(*_TIME)]))}
    out |= {k: _text(content[a:b]) for k, (a, b) in _TEXT.items()}
    return out | {k: struct.unpack_from(f, content, at)[0] for k, (f, at) in _NUMBERS.items()}


def samples(content: bytes) -> np.ndarray:
    return np.frombuffer(content, dtype=">u2", offset=HEADER).astype(np.float64) - ZERO


def encode(start: datetime, data: np.ndarray, **fields: str | int) -> bytes:
    """A file's bytes, for tests and exports."""
    head = bytearray(HEADER)
    day = (start - datetime(start.year, 1, 1)).days + 1
    raw = f"{start.year - 1900} {day:03d}:{start:%H:%M:%S}:{start.microsecond // 1000:03d}".encode()
    head[_TIME[0] : _TIME[0] + len(raw)] = raw
    for k, v in fields.items():
        if k in _TEXT:
            head[_TEXT[k][0] : _TEXT[k][0] + len(str(v))] = str(v).encode()
        else:
            struct.pack_into(_NUMBERS[k][0], head, _NUMBERS[k][1], v)
    return bytes(head) + (np.clip(np.round(data + ZERO), 0, 65535)).astype(">u2").tobytes()


#: Samples of a piece.
PIECE = 1 << 20
SAMPLE_SCHEMA = HEADER_SCHEMA + ", first_sample long, samples array<double>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC"), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def _number(path: str) -> int:
    return int(path.rsplit("/", 1)[-1].split(".")[0])


def _header_row(path: str, head: bytes) -> tuple:
    h = {"path": path, "file_number": _number(path)} | read_header(head)
    return tuple(h[c.split()[0]] for c in HEADER_SCHEMA.split(", "))


def header_batches(path: str, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
    """One row from a file's first bytes; none where they are too few."""
    head = f.read(HEADER)
    if len(head) == HEADER:
        schema = _arrow(HEADER_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(_header_row(path, head), schema)], schema=schema)


def sample_batches(path: str, f: pa.NativeFile, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A row for each piece of a file; none of a file without samples."""
    head, at = f.read(HEADER), 0
    if len(head) < HEADER:
        return
    schema = _arrow(SAMPLE_SCHEMA)
    row = _header_row(path, head)
    while content := f.read(2 * piece):
        x = np.frombuffer(content[: len(content) // 2 * 2], dtype=">u2").astype(np.float64) - ZERO
        if len(x):
            values = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([*[pa.array([v], k.type) for v, k in zip((*row, at), schema)], values], schema=schema)
        at += len(x)


def files(spark: SparkSession, path: str, glob: str = "*.DAT", only: Column | str | None = None) -> DataFrame:
    """(path, length, modificationTime, file_number) of the recordings below a folder; those for which only doesn't hold are never opened."""
    out = listing(spark, path, glob).withColumn("file_number", F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).try_cast("int"))
    return out if only is None else out.where(only)


def headers(spark: SparkSession, path: str, glob: str = "*.DAT", sort_by: str = "timestamp", only: Column | str | None = None) -> DataFrame:
    """A listing with header fields, by time or file number. 256 bytes of each file are read."""
    return decoded(files(spark, path, glob, only), header_batches, HEADER_SCHEMA).orderBy(sort_by, "path")


def recordings(spark: SparkSession, path: str, glob: str = "*.DAT", piece: int = PIECE, only: Column | str | None = None) -> DataFrame:
    """Header fields and samples (SAMPLE_SCHEMA), a row for each piece of a file."""
    return decoded(files(spark, path, glob, only), lambda p, f: sample_batches(p, f, piece), SAMPLE_SCHEMA)


def per_file(files: DataFrame, work: Callable[[str, dict, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """work(path, header, samples) on each file of a listing, whole in its task."""
    kinds = None

    def run(path: str, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        content = f.read()
        if len(content) >= HEADER:
            out = work(path, read_header(content), samples(content))
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return decoded(files, run, schema)


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class HydrophoneSource(DataSource):
    """spark.read.format("hydrophone").option("paths", "uri\\nuri").load(): SAMPLE_SCHEMA of listed files, in Arrow batches, the files dealt over `parts` partitions.

    The paths come from a listing by the session, see load(), which also leaves files out: filters that a Python source takes over stay with its reader
    in Spark 4.1, and would hold for later queries of the same table.
    """

    @classmethod
    def name(cls) -> str:
        return "hydrophone"

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split("\n") if p], int(self.options.get("parts", "1")))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], parts: int) -> None:
        self.paths, self.parts = paths, max(1, min(parts, len(paths)))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.paths[i :: self.parts]) for i in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with opened(path) as f:
                yield from sample_batches(path, f)


def load(spark: SparkSession, path: str, glob: str = "*.DAT", only: Column | str | None = None) -> DataFrame:
    """The recordings below a folder through the data source, in four partitions a core at most. Paths are a line of text a file."""
    spark.dataSource.register(HydrophoneSource)
    paths = sorted(r.path for r in files(spark, path, glob, only).select("path").collect())
    return spark.read.format("hydrophone").option("paths", "\n".join(paths)).option("parts", str(4 * spark.sparkContext.defaultParallelism)).load()
