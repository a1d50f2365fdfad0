"""Streams of detections: gap sessions with a watermark, and hysteresis triggers with state for each station."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRIGGERS = "mooring string, on_at timestamp, off_at timestamp, peak double"


def gap_sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(ts timestamp, mooring) to (mooring, begin, end, n); a session is given out when the watermark has passed it."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "mooring").agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return s.select("mooring", F.col("w.start").alias("begin"), "end", "n")


def triggers(series: DataFrame, on: float, off: float, late: str = "10 minutes") -> DataFrame:
    """(ts, mooring, value) to runs from value >= on up to the first value <= off, in order of time within each micro-batch.

    State is whether a station's trigger is up, since when and how high: a row a station.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, since, peak = state.get if state.exists else (False, 0, 0.0)
        out = []
        for f in frames:
            f = f.sort_values("ts")
            for t, v in zip(f["ts"], f["value"]):
                if up:
                    peak = max(peak, v)
                    if v <= off:
                        out.append((key[0], pd.Timestamp(since), t, peak))
                        up = False
                elif v >= on:
                    up, since, peak = True, t.value, v
        state.update((up, since, peak))
        yield pd.DataFrame(out, columns=["mooring", "on_at", "off_at", "peak"])

    return series.withWatermark("ts", late).groupBy("mooring").applyInPandasWithState(step, TRIGGERS, "up boolean, since long, peak double", "append", GroupStateTimeout.NoTimeout)
