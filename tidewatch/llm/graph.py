"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shared_folder

#: 16 bytes an edge: one task can hold so many.
LOCAL_EDGES = 1_000_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v) and the smallest that each reaches: minima along edges and through labels until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        new = new[low]
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _local(batches):
    """All edges of a bounded table in one task."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        nodes, low = lowest(*(np.concatenate(x) for x in zip(*got)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(low, pa.int64())], names=["node", "component"])


def _settled(df: DataFrame, path: str) -> DataFrame:
    """df's rows of two longs, written and read again.

    A checkpoint keeps the size that Spark expects of its plan, which a join multiplies: over rounds of joins that number itself, an
    integer of any length, has four times the digits after each, until it fills the driver. Files have their real size.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(", ".join(f"{x} long" for x in df.columns)).parquet(path)


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(a, b) rows to (node long, component long): the smallest node that each node reaches.

    Nulls and self-links are left out, repeated rows count once, and nodes without a link to another node are not returned.
    Up to local_edges edges, counted first, one executor task does it; beyond that it goes in rounds over the whole cluster: minima
    are aggregated before the shuffle and joined back by sort-merge joins, whose large keys Spark splits, so that a hub needs no task of its own.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"), (F.col("a") != F.col("b")).alias("ok")).where("ok").select("u", "v").distinct()
    e = keep(e)
    n = e.count()
    path = f"{shared_folder(e.sparkSession)}/components-{uuid.uuid4().hex}"
    if n <= local_edges:
        return _settled(e.coalesce(1).mapInArrow(_local, "node long, component long"), path)
    mark, turn = _mark(e), 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # two folders in turn: a round's edges are read until the next ones are written
        e = _settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{path}-{turn}")
        turn = 1 - turn
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def relabel(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with more links (a, b) among any nodes."""
    ends = []
    for x in ("a", "b"):
        links = links.join(found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_own")), x, "left")
        ends.append(F.coalesce(f"{x}_own", x))
    joined = components(links.select(ends[0].alias("a"), ends[1].alias("b")))
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = found.join(to, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return keep(old.unionByName(joined.join(found.select("node"), "node", "left_anti")))
