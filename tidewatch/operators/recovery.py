"""Picks that an association lacks: windows in which the missing stations should have heard the source, picks in them, and the source located again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import keep
from .location import FINE, misfit

#: Stations of an association that is looked at, margin in degrees of the search around its place, tiers that have a place.
STATIONS, PAD, TIERS = 3, 0.5, ("A", "B", "C")
#: Cells a side of the blocks in which a grid is looked over first.
_SIDE = 25
SCHEMA = "assoc_id string, new_lat double, new_lon double, new_residual double"


def windows(arrivals: DataFrame, pair_windows: DataFrame, seconds: bool = True) -> DataFrame:
    """(assoc_id, mooring, onset_us) to (assoc_id, mooring, lo, hi) of the stations that are missing: times within the pair's travel time of every pick there is.

    seconds: onsets count in whole seconds. Windows without any time are left out.
    """
    t = F.floor(F.col("onset_us") / 1_000_000) * 1_000_000 if seconds else F.col("onset_us")
    both = arrivals.select("assoc_id", F.col("mooring").alias("m1"), t.alias("_t")).join(pair_windows, "m1")
    w = both.groupBy("assoc_id", F.col("m2").alias("mooring")).agg(F.max(F.col("_t") - F.col("max_us")).alias("lo"), F.min(F.col("_t") + F.col("max_us")).alias("hi"))
    return w.where("lo <= hi").join(arrivals.select("assoc_id", "mooring"), ["assoc_id", "mooring"], "left_anti")


def candidates(wanted: DataFrame, catalogue: DataFrame, longest: int, seconds: bool = True) -> DataFrame:
    """Windows with the picks of their station in them: (assoc_id, mooring, event_id, onset_us, snr, off_us), off_us from the window's middle.

    Time is cut into pieces of the longest travel time; a window, twice as long at most, lies in three of them, and meets only picks of these.
    """
    at = F.floor(F.col("onset_us") / 1_000_000) * 1_000_000 if seconds else F.col("onset_us")
    picks = catalogue.where("snr > -1 AND NOT isnan(snr)").select("mooring", "event_id", "onset_us", "snr", at.alias("_t"), F.floor(at / longest).alias("_b"))
    asked = wanted.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / longest), F.floor(F.col("hi") / longest))))
    hit = asked.join(picks, ["mooring", "_b"]).where("_t >= lo AND _t < hi")
    return hit.select("assoc_id", "mooring", "event_id", "onset_us", "snr", F.abs(F.col("_t") - F.expr("(lo + hi) div 2")).alias("off_us"))


def strongest(found: DataFrame) -> DataFrame:
    """The strongest pick of each window, of equal ones the earliest. A pick may serve several associations."""
    order = Window.partitionBy("assoc_id", "mooring").orderBy(F.desc("snr"), "onset_us", "event_id")
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def one_to_one(found: DataFrame) -> DataFrame:
    """Each pick to one association at most: windows ask for their strongest pick, and a pick goes with the association in the middle of whose window it is most nearly.

    A window that is refused asks for its next pick, until no window is refused: the stable matching that is best for the windows.
    """
    ask = Window.partitionBy("assoc_id", "mooring").orderBy(F.desc("snr"), "onset_us", "event_id")
    choose = Window.partitionBy("event_id").orderBy("off_us", "assoc_id")
    left = keep(found)
    while True:
        asked = left.withColumn("_k", F.row_number().over(ask)).where("_k = 1").drop("_k").withColumn("_c", F.row_number().over(choose))
        asked = keep(asked)
        refused = asked.where("_c > 1").select("assoc_id", "mooring", "event_id")
        if refused.isEmpty():
            return asked.drop("_c")
        left = keep(left.join(refused, ["assoc_id", "mooring", "event_id"], "left_anti"))


def search_around(lat: float, lon: float, onsets: dict[str, float], speed: float = geo.SPEED, pad: float = PAD, step: float = FINE) -> tuple[float, float, float]:
    """Latitude, longitude and misfit of the best cell of a flat grid around a place, the first of equal ones.

    The middles of blocks are looked at first. No misfit changes faster than time with distance, so that most blocks can't hold the best cell.
    """
    y, x = np.arange(lat - pad, lat + pad, step), np.arange(lon - pad, lon + pad, step)
    wide = 111.0 * np.cos(np.radians(lat))
    place = {m: (a, o) for m, a, o, _ in geo.STATIONS if m in onsets}

    def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return misfit({m: np.hypot((y[i] - a) * 111.0, (x[j] - o) * wide) for m, (a, o) in place.items()}, onsets, speed)

    blocks = [np.arange(0, len(v), _SIDE) for v in (y, x)]
    bi, bj = (b.ravel() for b in np.meshgrid(*blocks, indexing="ij"))
    at = fit(np.minimum(bi + _SIDE // 2, len(y) - 1), np.minimum(bj + _SIDE // 2, len(x) - 1))
    n = len(onsets)
    reach = (_SIDE // 2 + 1) * step * np.hypot(111.0, wide)
    able = at <= at.min() + 1000 / speed * np.sqrt(2 * n / (n - 1)) * reach
    d = np.arange(_SIDE)
    i = (bi[able][:, None, None] + d[:, None] + 0 * d).ravel()
    j = (bj[able][:, None, None] + 0 * d[:, None] + d).ravel()
    ok = (i < len(y)) & (j < len(x))
    i, j = i[ok], j[ok]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    rms = fit(i, j)
    k = int(rms.argmin())
    return float(y[i[k]]), float(x[j[k]]), float(rms[k])


def recover(located: DataFrame, arrivals: DataFrame, catalogue: DataFrame, exclusive: bool = False, seconds: bool = True, pair_windows: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """Associations of three stations with a place, with the picks of other stations that fit all of theirs, and located again with these.

    located: (assoc_id, lat, lon, residual_s, quality_tier, n_moorings); arrivals: (assoc_id, mooring, onset_us); catalogue: (event_id, mooring,
    onset_us, snr). exclusive: a pick serves one association only. What gains no pick, or has no latitude, keeps its place.
    """
    spark = located.sparkSession
    if pair_windows is None:
        pair_windows = geo.pair_windows(spark)
        longest = max(round(p[4] * 1e6) for p in geo.pair_table())
    target = located.where(F.col("quality_tier").isin(*TIERS) & (F.col("n_moorings") == STATIONS))
    own = arrivals.join(target.select("assoc_id"), "assoc_id", "left_semi").groupBy("assoc_id", "mooring").agg(F.min("onset_us").alias("onset_us"))
    found = candidates(windows(own, pair_windows, seconds), catalogue, longest, seconds)
    won = keep((one_to_one if exclusive else strongest)(found).select("assoc_id", "mooring", "onset_us"))
    gained = won.groupBy("assoc_id").agg(F.count("*").cast("int").alias("n_recovered"), F.array_join(F.array_sort(F.collect_list("mooring")), ",").alias("recovered_moorings"))
    t = F.floor(F.col("onset_us") / 1_000_000) * 1_000_000 if seconds else F.col("onset_us")
    every = own.join(gained.select("assoc_id"), "assoc_id", "left_semi").unionByName(won).select("assoc_id", "mooring", t.alias("t"))
    # as many as there are stations
    onsets = every.groupBy("assoc_id").agg(F.map_from_entries(F.collect_list(F.struct("mooring", "t"))).alias("onsets"))
    todo = target.where("lat IS NOT NULL AND lon IS NOT NULL").join(onsets, "assoc_id").select("assoc_id", "lat", "lon", "onsets")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, lat, lon, o in zip(f["assoc_id"], f["lat"], f["lon"], f["onsets"]):
                o = dict(o)
                begin = min(o.values())
                out.append((a, *search_around(lat, lon, {m: (v - begin) / 1e6 for m, v in o.items()})))
            yield pd.DataFrame(out, columns=["assoc_id", "new_lat", "new_lon", "new_residual"])

    again = todo.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "assoc_id").mapInPandas(run, SCHEMA).join(gained, "assoc_id")
    n = F.coalesce("n_recovered", F.lit(0))
    return target.select("assoc_id", F.col("lat").alias("orig_lat"), F.col("lon").alias("orig_lon"), F.col("residual_s").alias("orig_residual"), F.col("n_moorings").alias("orig_n_moorings")).join(again, "assoc_id", "left").select(
        "assoc_id", "orig_lat", "orig_lon", "orig_residual", "orig_n_moorings",
        *[F.coalesce(f"new_{c}", f"orig_{c}").alias(f"new_{c}") for c in ("lat", "lon", "residual")],
        (F.col("orig_n_moorings") + n).alias("new_n_moorings"), n.alias("n_recovered"), "recovered_moorings",
    )
