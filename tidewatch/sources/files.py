"""Files as rows: listing through the session's file system, reading parts of them in tasks, and writing them from tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder. No content is read."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def data_dir(spark: SparkSession, full: str, subset: str) -> str:
    """The folder of all data where there is one, else that of a part of it."""
    return full if exists(spark, full) else subset


def opened(path: str) -> pa.NativeFile:
    """A file by its URI, for reading parts of it in a task."""
    import pyarrow.fs

    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def decoded(files: DataFrame, work: Callable[[str, pa.NativeFile], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(path, open file) on each file of (path, length): it reads what it needs and yields batches. A file is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with opened(path) as f:
                    yield from work(path, f)

    # a listing is a few bytes a file: a number given here is not coalesced by size
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(n, "path").mapInArrow(run, schema)


def stored(folder: str, name: str, content: bytes) -> None:
    """Writes a file below a folder, whole under its name or not at all."""
    import pyarrow.fs

    fs, to = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}" if "://" in folder or folder.startswith("file:") else f"file://{folder}/{name}")
    fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(to + ".part") as f:
        f.write(content)
    fs.move(to + ".part", to)


def written(contents: DataFrame, folder: str) -> list[str]:
    """Writes (name, content binary) below a folder, each by the task that has it; a task that is tried again writes the same. The names, in order."""
    ship(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stored(folder, name, content)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["name"])

    return sorted(r.name for r in contents.select("name", F.col("content").cast("binary")).mapInArrow(run, "name string").collect())


def written_groups(rows: DataFrame, keys: list[str], make: Callable[[tuple, pa.Table], tuple[str, bytes]], folder: str) -> list[str]:
    """As written, a file for each group of rows: make(key, rows) gives its name and content, and no task holds more than one group at a time."""
    ship(rows.sparkSession)

    def run(key: tuple, own: pa.Table) -> pa.Table:
        name, content = make(tuple(k.as_py() for k in key), own)
        stored(folder, name, content)
        return pa.table({"name": [name]})

    return sorted(r.name for r in rows.groupBy(*keys).applyInArrow(run, "name string").collect())
