"""Spectrogram patches around an onset and the features of one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .signal import FS, bandwidth, bilinear_zoom, decibels, spectrogram


@dataclass(frozen=True)
class Variant:
    pre_s: float
    post_s: float
    nperseg: int
    noverlap: int
    freq_min: float
    freq_max: float
    edges: tuple[float, ...]


#: Seconds before and after the onset, frame and overlap, frequency range, band edges in Hz.
GENERAL = Variant(5, 10, 1024, 512, 0, 250, tuple(float(25 * i) for i in range(11)))
LOW = Variant(5, 10, 2048, 1024, 1, 14, (1.0, 3.0, 5.0, 7.0, 9.0, 11.0, 14.0))
HIGH = Variant(2, 8, 1024, 512, 30, 450, (30.0, 60.0, 100.0, 160.0, 250.0, 350.0, 450.0))


def patch(data: np.ndarray, onset: int, v: Variant = GENERAL, fs: int = FS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Frequencies, times and power around an onset; None where the window leaves the file."""
    a, b = onset - int(v.pre_s * fs), onset + int(v.post_s * fs)
    if a < 0 or b > len(data) or b - a < v.nperseg:
        return None
    f, t, p = spectrogram(data[a:b], fs, v.nperseg, v.noverlap)
    keep = (f >= v.freq_min) & (f <= v.freq_max)
    return (f[keep], t, p[keep]) if keep.any() else None


#: The level of a band without a frequency, and what keeps the logarithm of nothing finite.
SILENT_DB, FLOOR = -200.0, 1e-20


class Spectrum:
    """The frames of a patch that lie in an event, or all frames where none does; what the measures below have in common."""

    def __init__(self, freq: np.ndarray, times: np.ndarray, power: np.ndarray, onset_s: float, end_s: float) -> None:
        at = np.flatnonzero((times >= onset_s) & (times <= end_s))
        at = at if at.size else np.arange(times.size)
        self.freq, self.times, self.power = freq, times[at], power[:, at]
        self.onset_s, self.end_s = onset_s, end_s
        self.level = decibels(self.power)
        self.mean = self.power.mean(axis=1)


def bands(s: Spectrum, edges: tuple[float, ...]) -> np.ndarray:
    """The mean level of each band, its lower edge included."""
    band = np.searchsorted(edges, s.freq, side="right")
    n = np.bincount(band, minlength=len(edges) + 1)[1 : len(edges)]
    total = np.bincount(band, s.level.mean(axis=1), minlength=len(edges) + 1)[1 : len(edges)]
    return np.where(n > 0, total / np.maximum(n, 1), SILENT_DB)


def rise_and_decay(s: Spectrum) -> tuple[float, float]:
    """Seconds from the onset to the loudest frame, and from there to the end; half each where one frame can't tell."""
    if s.times.size == 1:
        return ((s.end_s - s.onset_s) / 2,) * 2
    loudest = float(s.times[s.power.sum(axis=0).argmax()])
    return loudest - s.onset_s, s.end_s - loudest


def slope(s: Spectrum) -> float:
    """Of the line through log power by log frequency, above 0 Hz; 0 for fewer than three frequencies or silence."""
    x, y = np.log10(s.freq[s.freq > 0]), s.mean[s.freq > 0]
    if x.size < 3 or not y.any():
        return 0.0
    x = x - x.mean()
    return float(x @ np.log10(y + FLOOR) / (x @ x))


def modulation(s: Spectrum) -> float:
    """The spread of the frames' strongest frequencies; 0 for one or two frames."""
    return float(s.freq[s.power.argmax(axis=0)].std()) if s.times.size > 2 else 0.0


def centroid(s: Spectrum) -> float:
    """The mean frequency, weighted by power; 0 for silence."""
    return float(np.average(s.freq, weights=s.mean)) if s.mean.sum() > 0 else 0.0


def features(f: np.ndarray, t: np.ndarray, p: np.ndarray, onset_s: float, end_s: float, edges: tuple[float, ...]) -> dict[str, float]:
    """All measures of an event in its patch, by name."""
    s = Spectrum(f, t, p, onset_s, end_s)
    rise, decay = rise_and_decay(s)
    return {f"band_power_{i}": float(v) for i, v in enumerate(bands(s, edges))} | {
        "peak_freq_hz": float(f[s.mean.argmax()]), "peak_power_db": float(s.level.max()), "bandwidth_hz": bandwidth(f, s.mean), "duration_s": end_s - onset_s,
        "rise_time_s": rise, "decay_time_s": decay, "spectral_slope": slope(s), "freq_modulation": modulation(s), "spectral_centroid_hz": centroid(s),
    }


def classifier_patch(data: np.ndarray, onset: int, fs: int = FS) -> np.ndarray | None:
    """Decibels of eight seconds up to 100 Hz, 64 frequencies by 128 frames."""
    got = patch(data, onset, Variant(2, 6, 256, 224, 0, 100, ()), fs)
    return None if got is None else bilinear_zoom(decibels(got[2]), 64, 128).astype(np.float32)


def shared_limits(panels: list[np.ndarray]) -> tuple[float, float]:
    """Second and ninety-eighth percentile over all panels."""
    lo, hi = np.percentile(np.concatenate([decibels(p).ravel() for p in panels]), [2, 98])
    return float(lo), float(hi)
