"""Files to catalogues: detection, onset refinement and features, a file to a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import dat
from . import features, onsets, signal

CATALOGUE = "mooring string, file_number int, instrument_id string, onset_us long, end_us long, on_samp long, off_samp long, detection_band string, detection_pass int, duration_s double, peak_freq_hz double, bandwidth_hz double, peak_db double, snr double"
_REFINED = ", onset_shift_s double, onset_method string, onset_quality double, onset_grade string"
_FEATURES = ", " + ", ".join(f"{n} double" for n in [*(f"band_power_{i}" for i in range(10)), "f_peak_freq_hz", "f_peak_power_db", "f_bandwidth_hz", "f_duration_s", "rise_time_s", "decay_time_s", "spectral_slope", "freq_modulation", "spectral_centroid_hz"])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def of_file(mooring: str, number: int, instrument: str, start_us: int, data: np.ndarray, fs: int = signal.FS) -> pd.DataFrame:
    """Detections of one file with refined onsets and general features. An event's search for its onset ends at the end of the event before."""
    rows, ends = [], {}
    for e in sorted(signal.detect_all(data, fs), key=lambda e: (e["detection_band"], e["on_samp"])):
        shift, method, quality = onsets.refine(data, e["on_samp"], e["detection_pass"], ends.get(e["detection_band"]), fs)
        ends[e["detection_band"]] = e["off_samp"]
        row = {"mooring": mooring, "file_number": number, "instrument_id": instrument, "onset_us": start_us + e["on_samp"] * 1_000_000 // fs, "end_us": start_us + e["off_samp"] * 1_000_000 // fs} | e
        row |= {"onset_shift_s": shift / fs, "onset_method": method, "onset_quality": quality, "onset_grade": onsets.grade(quality)}
        got = features.patch(data, e["on_samp"], fs=fs)
        if got:
            f = features.features(*got, features.GENERAL.pre_s, features.GENERAL.pre_s + (e["off_samp"] - e["on_samp"]) / fs, features.GENERAL.edges)
            row |= {(f"f_{k}" if k in ("peak_freq_hz", "peak_power_db", "bandwidth_hz", "duration_s") else k): v for k, v in f.items()}
        rows.append(row)
    out = pd.DataFrame(rows, columns=_names(CATALOGUE + _REFINED + _FEATURES))
    return out.astype({c: "float64" for c in _names(_FEATURES[2:])})


def catalogue(files: DataFrame, mooring: str | None = None) -> DataFrame:
    """The catalogue of a listing of recordings: of one station, or, without its name, of those that the files' folders name."""

    def work(path: str, header: dict, data: np.ndarray) -> pd.DataFrame:
        start = int((header["timestamp"] - pd.Timestamp("1970-01-01", tz=header["timestamp"].tzinfo)) / pd.Timedelta(microseconds=1))
        return of_file(mooring or path.rsplit("/", 2)[-2], dat._number(path), header["instrument_id"], start, data, header["sample_rate"] or signal.FS)

    return dat.per_file(files, work, CATALOGUE + _REFINED + _FEATURES)


VARIANT = "mooring string, file_number int, detection_band string, on_samp long, variant string, " + ", ".join(f"{n} double" for n in [*(f"band_power_{i}" for i in range(6)), "peak_freq_hz", "peak_power_db", "bandwidth_hz", "duration_s", "rise_time_s", "decay_time_s", "spectral_slope", "freq_modulation", "spectral_centroid_hz"])


def variants(files: DataFrame) -> DataFrame:
    """Features of the low and the high band's own patches, of detections in the low band and in the others; none where a patch leaves its file."""

    def work(path: str, header: dict, data: np.ndarray) -> pd.DataFrame:
        fs, rows = header["sample_rate"] or signal.FS, []
        for e in signal.detect_all(data, fs):
            name, v = ("lowband", features.LOW) if e["detection_band"] == "low" else ("highband", features.HIGH)
            if got := features.patch(data, e["on_samp"], v, fs):
                rows.append({"mooring": path.rsplit("/", 2)[-2], "file_number": dat._number(path), "detection_band": e["detection_band"], "on_samp": e["on_samp"], "variant": name} | features.features(*got, v.pre_s, v.pre_s + (e["off_samp"] - e["on_samp"]) / fs, v.edges))
        return pd.DataFrame(rows, columns=_names(VARIANT))

    return dat.per_file(files, work, VARIANT)


IMAGE = "mooring string, file_number int, detection_band string, on_samp long, height int, width int, image array<float>, low_db double, high_db double"


def images(files: DataFrame) -> DataFrame:
    """The classifier's picture of each detection, 64 frequencies by 128 frames in a row, and the limits of level that the pictures of a file share."""

    def work(path: str, header: dict, data: np.ndarray) -> pd.DataFrame:
        fs, rows, panels = header["sample_rate"] or signal.FS, [], []
        for e in signal.detect_all(data, fs):
            x = features.classifier_patch(data, e["on_samp"], fs)
            got = features.patch(data, e["on_samp"], fs=fs)
            if x is not None and got:
                panels.append(got[2])
                rows.append((path.rsplit("/", 2)[-2], dat._number(path), e["detection_band"], e["on_samp"], *x.shape, x.ravel()))
        lo, hi = features.shared_limits(panels) if panels else (None, None)
        return pd.DataFrame([(*r, lo, hi) for r in rows], columns=_names(IMAGE))

    return dat.per_file(files, work, IMAGE)


RESCUED = "mooring string, file_number int, cluster string, on_samp long, onset_quality double, onset_grade string, rescue_method string, rescue_shift_s double, rescue_quality double"


def rescued(files: DataFrame, clusters: dict[str, str]) -> DataFrame:
    """Detections of the bands that stand for a cluster of sources, with the onset that rescue finds in the cluster's filter and window."""

    def work(path: str, header: dict, data: np.ndarray) -> pd.DataFrame:
        fs, rows, ends = header["sample_rate"] or signal.FS, [], {}
        for e in sorted(signal.detect_all(data, fs), key=lambda e: (e["detection_band"], e["on_samp"])):
            _, _, quality = onsets.refine(data, e["on_samp"], e["detection_pass"], ends.get(e["detection_band"]), fs)
            ends[e["detection_band"]] = e["off_samp"]
            name = clusters.get(e["detection_band"])
            window = name and onsets.cluster_window(data, e["on_samp"], name, fs)
            if window:
                g = onsets.grade(quality)
                rows.append((path.rsplit("/", 2)[-2], dat._number(path), name, e["on_samp"], quality, g, *onsets.rescue(*window, quality, g, fs)))
        return pd.DataFrame(rows, columns=_names(RESCUED)).astype({"rescue_shift_s": "float64"})

    return dat.per_file(files, work, RESCUED)


def of_series(series: DataFrame, fs: int = signal.FS) -> DataFrame:
    """(mooring, file_number, start_us, samples array<double>) to a catalogue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for m, n, s, x in zip(f["mooring"], f["file_number"], f["start_us"], f["samples"]):
                yield of_file(m, int(n), "", int(s), np.asarray(x, dtype=float), fs)

    return series.select("mooring", "file_number", "start_us", "samples").mapInPandas(run, CATALOGUE + _REFINED + _FEATURES)


def numbered(catalogue_: DataFrame) -> DataFrame:
    """With event_id, E and six digits, by time; ranks within a day after the counts of the days before."""
    c = catalogue_.withColumn("_d", F.floor(F.col("onset_us") / 86_400_000_000))
    n = c.groupBy("_d").agg(F.count("*").alias("_n"))
    b = n.select("_d", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    k = F.row_number().over(Window.partitionBy("_d").orderBy("onset_us", "mooring", "detection_band", "file_number", "on_samp")) - 1
    return c.withColumn("_k", k).join(b, "_d").withColumn("event_id", F.format_string("E%06d", F.col("_b") + F.col("_k"))).drop("_d", "_n", "_b", "_k")
