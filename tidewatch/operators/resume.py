"""Work in steps whose results are committed one by one, so that a run that was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A step's rows, and a row for each step that is finished.
_DATA, _DONE = "data", "done"


class Steps:
    """A folder of finished steps. A step's rows are written to a folder of its own, and then a row that says so.

    What a stopped run has left of a step without that row is overwritten, and never read. Steps are numbered.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def finished(self) -> list[int]:
        """Numbers of the finished steps: a run has some hundreds."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/{_DONE}").select("step").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return []
            raise
        return sorted(r.step for r in rows)

    def read(self, step: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{_DATA}/{step}")

    def all(self) -> DataFrame | None:
        """The rows of all finished steps; None without any."""
        done = self.finished()
        if not done:
            return None
        return self.spark.read.parquet(*[f"{self.path}/{_DATA}/{s}" for s in done])

    def commit(self, step: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{_DATA}/{step}")
        self.spark.range(1).select(F.lit(step).alias("step")).coalesce(1).write.mode("append").parquet(f"{self.path}/{_DONE}")

    def run(self, steps: Iterable[int], work: Callable[[int], DataFrame]) -> list[int]:
        """Does what isn't finished, in order, and tells which steps that were."""
        done, did = set(self.finished()), []
        for s in steps:
            if s not in done:
                self.commit(s, work(s))
                did.append(s)
        return did
