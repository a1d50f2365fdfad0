"""Running values over ordered rows without a task for each key: rows are scanned in parts of their order, and what a part needs of the ones before is a row.

A station's whole archive is one key, so that a window over it would be one task. Here a window covers a part (a day); its totals go into a small
table with a row for each key and part, whose running values are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a part.
DAY = 86_400_000_000


class Scan:
    """Rows of each key in the order of some columns, the first of which (t) is a number that parts are cut by. The order must be total."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], width: int = DAY) -> None:
        self.keys, self.order = list(keys), list(order)
        self.df = df.withColumn("_p", F.floor(F.col(order[0]) / width))

    def running(self, value: Column | str, how: str, name: str, before: bool = False) -> Scan:
        """With the sum, the max, or the last value that is not null ("last") up to each row, or up to the row before it."""
        value = F.expr(value) if isinstance(value, str) else value
        df = self.df.withColumn("_v", value)
        w = Window.partitionBy(*self.keys, "_p").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        of = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
        place = F.struct(*self.order)
        total = F.max_by("_v", F.when(F.col("_v").isNotNull(), place)) if how == "last" else of("_v")
        parts = df.groupBy(*self.keys, "_p").agg(total.alias("_t"))
        # a row for each key and part
        over = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_b", of("_t").over(over)).drop("_t")
        local = df.withColumn("_l", of("_v").over(w))
        both = {"sum": F.coalesce("_l", F.lit(0)) + F.coalesce("_b", F.lit(0)), "max": F.greatest("_l", "_b"), "last": F.coalesce("_l", "_b")}[how]
        out = Scan.__new__(Scan)
        out.keys, out.order = self.keys, self.order
        out.df = local.join(parts, [*self.keys, "_p"]).withColumn(name, both).drop("_v", "_l", "_b")
        return out

    def previous(self, name: str, *columns: str) -> Scan:
        """With a struct of the columns of the row before, null for a key's first row."""
        return self.running(F.struct(*columns), "last", name, before=True)

    def rows(self) -> DataFrame:
        return self.df.drop("_p")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island", width: int = DAY) -> DataFrame:
    """Numbers, from 0, the runs that begin where breaks holds. breaks may use prev, the row before's columns of the order."""
    s = Scan(df, keys, order, width).previous("prev", *order)
    s.df = s.df.withColumn("_break", (F.col("prev").isNotNull() & F.coalesce(breaks, F.lit(False))).cast("long"))
    return s.running("_break", "sum", name).rows().drop("prev", "_break")


def merge_intervals(df: DataFrame, start: str, end: str, keys: list[str] = (), width: int = DAY) -> DataFrame:
    """Overlapping or touching intervals as one, by key: (keys..., start, end, n)."""
    s = Scan(df, keys, [start, end], width)
    # equal intervals are one with a count: the order is total then
    s.df = s.df.groupBy(*keys, start, end, "_p").agg(F.count("*").alias("_n"))
    s = s.running(end, "max", "_top", before=True)
    s.df = s.df.withColumn("_new", (F.col("_top").isNull() | (F.col(start) > F.col("_top"))).cast("long"))
    return s.running("_new", "sum", "_run").rows().groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("_run")


def triggers(df: DataFrame, keys: list[str], order: list[str], value: str, on: float, off: float, width: int = DAY) -> DataFrame:
    """Hysteresis: (keys..., on_at, off_at), row numbers from 0, of each run from value >= on up to the first value <= off; an open run ends at the last row."""
    s = Scan(df, keys, order, width).running(F.lit(1).cast("long"), "sum", "_i")
    s = s.running(F.when(F.col(value) >= on, 1).when(F.col(value) <= off, 0), "last", "_s")
    s.df = s.df.withColumn("_s", F.coalesce("_s", F.lit(0))).withColumn("_i", F.col("_i") - 1)
    s = s.running("_s", "last", "_was", before=True)
    was = F.coalesce("_was", F.lit(0))
    s.df = s.df.withColumn("_up", ((F.col("_s") == 1) & (was == 0)).cast("long")).withColumn("_down", F.when((F.col("_s") == 0) & (was == 1), F.col("_i")))
    runs = s.running("_up", "sum", "_run").rows().where("_run > 0")
    return runs.groupBy(*keys, "_run").agg(F.min("_i").alias("on_at"), F.coalesce(F.min("_down"), F.max("_i")).alias("off_at")).drop("_run")


#: Rows of a block.
BLOCK = 4096


def framed(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, width: int = DAY, block: int = BLOCK) -> DataFrame:
    """Rows in blocks of their number within the key (_i, from 0), each with the rows before and after it that frames of its own rows reach (_own is false for these).

    A window by frame() over such a block gives its own rows what a window over the whole key would; then keep the rows where _own holds.
    """
    s = Scan(df, keys, order, width).running(F.lit(1).cast("long"), "sum", "_i").rows().withColumn("_i", F.col("_i") - 1)
    at = F.sequence(F.greatest(F.floor((F.col("_i") - after) / block), F.lit(0)), F.floor((F.col("_i") + before) / block))
    return s.withColumn("_block", F.explode(at)).withColumn("_own", F.col("_block") == F.floor(F.col("_i") / block))


def frame(keys: list[str]):
    return Window.partitionBy(*keys, "_block").orderBy("_i")
