"""Choices of a few examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Examples of a class; a class with fewer than so many events for each example is not sliced.
EXAMPLES, SLICED = 6, 4


def ranked(df: DataFrame, label: str, value: str, id: str) -> DataFrame:
    """With rn, from 1, by falling value and id within a label, and n, the label's rows; rows are ranked within whole values, after the counts of larger ones."""
    at = df.withColumn("_b", F.floor(value))
    sizes = at.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy(F.desc("_b"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn("n", F.sum("_n").over(Window.partitionBy(label))).drop("_n")
    own = F.row_number().over(Window.partitionBy(label, "_b").orderBy(F.desc(value), id))
    return at.withColumn("_k", own).join(sizes, [label, "_b"]).withColumn("rn", F.col("_before") + F.col("_k")).drop("_b", "_k", "_before")


def one_per_slice(df: DataFrame, label: str, value: str, station: str, id: str, examples: int = EXAMPLES) -> DataFrame:
    """(label, pick, id, station, value): of each slice of a label's rows by falling value the first of a station that no slice before has given, else the first.

    A label of fewer than SLICED rows an example gives its first rows. Rows must have a value. The choice goes from slice to slice with the stations
    that it has; what it goes over are the first rows of each station in each slice.
    """
    r = ranked(df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(label, value, station, id), label, value, id)
    many = F.col("n") >= examples * SLICED
    head = r.where(~many & (F.col("rn") <= examples)).select(label, F.col("rn").cast("int").alias("pick"), id, station, value)
    cut = r.where(many).withColumn("slice", F.expr(f"(rn - 1) div (n div {examples})").cast("int")).where(F.col("slice") < examples)
    firsts = cut.groupBy(label, "slice", station).agg(F.min(F.struct("rn", id, value)).alias("f"))
    rows = firsts.select(label, "slice", F.struct(F.col("f.rn").alias("rn"), F.col(f"f.{id}").alias("id"), F.col(station).alias("station"), F.col(f"f.{value}").alias("value")).alias("r"))
    slices = rows.groupBy(label, "slice").agg(F.array_sort(F.collect_list("r")).alias("rows")).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("slice", "rows"))).alias("slices"))

    def step(state, s):
        fresh = F.try_element_at(F.filter(s["rows"], lambda x: ~F.array_contains(state["used"], x["station"])), F.lit(1))
        one = F.coalesce(fresh, s["rows"][0])
        return F.struct(F.array_union(state["used"], F.array(one["station"])).alias("used"), F.concat(state["picked"], F.array(one)).alias("picked"))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    start = F.struct(F.array().cast(f"array<{kinds[station]}>").alias("used"), F.array().cast(f"array<struct<rn:bigint,id:{kinds[id]},station:{kinds[station]},value:{kinds[value]}>>").alias("picked"))
    chosen = slices.select(label, F.posexplode(F.aggregate("slices", start, step)["picked"]).alias("pick", "r"))
    return head.unionByName(chosen.select(label, (F.col("pick") + 1).alias("pick"), F.col("r.id").alias(id), F.col("r.station").alias(station), F.col("r.value").alias(value)))
