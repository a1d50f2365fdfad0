"""Which events an analyst has judged: the seeded samples of each cluster drawn again, so that panels have event ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import DAY, Scan

#: Events of a sample, strata by distance from the cluster's middle, seeds of the two kinds of samples.
SAMPLE, STRATA, SEEDS = 30, 5, {"stratified": 42, "random": 43}


def sampled(events: DataFrame, kind: str, order: str = "event_id", n: int = SAMPLE, width: int = DAY) -> DataFrame:
    """(event_id, cluster_id, x, y) to (cluster_id, event_id, panel): the events that a sample of each cluster has, and their panels, from 1.

    stratified: as many of each fifth of the distances from the cluster's middle, panels by distance; random: of all, panels as drawn. Which rows are
    drawn goes by their places in the table's order (an integer column, parted by width) and by how many there are, which for a cluster are five numbers.
    """
    middle = events.groupBy("cluster_id").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"), F.count("*").alias("_n"))
    e = events.join(middle, "cluster_id").withColumn("dist", F.sqrt(F.pow(F.col("x") - F.col("_cx"), 2) + F.pow(F.col("y") - F.col("_cy"), 2)))
    if kind == "stratified":
        strata = F.least(F.lit(STRATA), F.col("_n"), F.lit(n))
        cuts = e.groupBy("cluster_id").agg(*[F.percentile("dist", F.array(*[F.lit(i / b) for i in range(b + 1)])).alias(f"_e{b}") for b in range(1, STRATA + 1)])
        e = e.join(cuts, "cluster_id")
        edges = F.array_distinct(F.element_at(F.array(*[F.col(f"_e{b}") for b in range(1, STRATA + 1)]), strata.cast("int")))
        # bins are closed on the right, the first one on both sides
        e = e.withColumn("_edges", edges).withColumn("bin", F.size(F.filter(F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0))), lambda c: c < F.col("dist")))).drop("_edges", *[f"_e{b}" for b in range(1, STRATA + 1)])
    else:
        e = e.withColumn("bin", F.lit(0))
    sizes: dict = {}
    for r in sorted(e.groupBy("cluster_id", "bin").agg(F.count("*").alias("n")).collect(), key=lambda r: (str(r.cluster_id), r.bin)):
        sizes.setdefault(r.cluster_id, []).append((r.bin, r.n))
    drawn = []
    for cluster, own in sizes.items():
        rng, total = np.random.default_rng(SEEDS[kind]), sum(k for _, k in own)
        m = min(n, total)
        parts = min(STRATA, m) if kind == "stratified" else 1
        for i, (b, k) in enumerate(own):
            take = min(m // parts + (i < m % parts), k)
            drawn += [(cluster, b, int(p), j) for j, p in enumerate(rng.choice(k, size=take, replace=False))]
    spark = events.sparkSession
    kinds = events.schema["cluster_id"].dataType.simpleString()
    places = spark.createDataFrame(drawn, f"cluster_id {kinds}, bin int, place long, draw int")
    at = Scan(e, ["cluster_id", "bin"], [order], width).running(F.lit(1).cast("long"), "sum", "_i").rows().withColumn("place", F.col("_i") - 1)
    chosen = at.join(places, ["cluster_id", "bin", "place"])
    # a cluster's sample is n rows
    panel = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*(("dist", order) if kind == "stratified" else ("draw",))))
    return chosen.select("cluster_id", "event_id", panel.alias("panel"))


def judged(events: DataFrame, verdicts: DataFrame, order: str = "event_id", width: int = DAY) -> DataFrame:
    """Verdicts (cluster_id, sample, panel, ...) with the event_id of their panel; null where a sample has no such panel."""
    both = None
    for kind in SEEDS:
        s = sampled(events, kind, order, width=width).withColumn("sample", F.lit(kind))
        both = s if both is None else both.unionByName(s)
    return verdicts.join(both, ["cluster_id", "sample", "panel"], "left")
