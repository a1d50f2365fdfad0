"""Features of patches against loops over their cells, and the jobs over files that make them."""

import math

import numpy as np
import pytest

from tidewatch.operators import features, onsets
from tidewatch.plans import physics

SF = "/root/testdata/sf0.001"


def plain(f, t, p, onset, end, edges):
    own = [j for j in range(len(t)) if onset <= t[j] <= end] or list(range(len(t)))
    db = lambda v: 10 * math.log10(v + 1e-20)
    mean = [sum(p[i, j] for j in own) / len(own) for i in range(len(f))]
    out = {}
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cells = [db(p[i, j]) for i in range(len(f)) if lo <= f[i] < hi for j in own]
        out[f"band_power_{k}"] = sum(cells) / len(cells) if cells else -200.0
    loud = max(own, key=lambda j: (sum(p[:, j]), -j))
    some = [(math.log10(f[i]), math.log10(mean[i] + 1e-20)) for i in range(len(f)) if f[i] > 0]
    slope = 0.0
    if len(some) > 2 and any(mean[i] > 0 for i in range(len(f)) if f[i] > 0):
        mx, my = (sum(v[k] for v in some) / len(some) for k in (0, 1))
        slope = sum((x - mx) * (y - my) for x, y in some) / sum((x - mx) ** 2 for x, _ in some)
    tops = [f[max(range(len(f)), key=lambda i: (p[i, j], -i))] for j in own]
    mt = sum(tops) / len(tops)
    return out | {
        "peak_freq_hz": f[max(range(len(f)), key=lambda i: (mean[i], -i))], "peak_power_db": max(db(p[i, j]) for i in range(len(f)) for j in own), "duration_s": end - onset,
        "rise_time_s": t[loud] - onset if len(own) > 1 else (end - onset) / 2, "decay_time_s": end - t[loud] if len(own) > 1 else (end - onset) / 2,
        "spectral_slope": slope, "freq_modulation": math.sqrt(sum((x - mt) ** 2 for x in tops) / len(tops)) if len(own) > 2 else 0.0, "spectral_centroid_hz": sum(a * b for a, b in zip(f, mean)) / sum(mean) if sum(mean) > 0 else 0.0,
    }


@pytest.mark.parametrize("onset, end, scale", [(2.0, 5.0, 1.0), (2.0, 2.3, 1.0), (2.2, 2.55, 1.0), (50.0, 60.0, 1.0), (1.0, 9.0, 0.0)])
def test_features(onset, end, scale):
    rng = np.random.default_rng(int(onset * 10))
    f, t = np.arange(0.0, 60.0, 1.5), np.arange(0.25, 10, 0.5)
    p = scale * rng.gamma(0.5, 1.0, (len(f), len(t)))
    edges = (0.0, 10.0, 10.5, 11.5, 40.0, 100.0, 120.0)
    got = features.features(f, t, p, onset, end, edges)
    want = plain(f, t, p, onset, end, edges)
    assert {k: v for k, v in got.items() if k != "bandwidth_hz"} == pytest.approx(want)
    assert 0 <= got["bandwidth_hz"] <= f[-1]


def test_cluster_window():
    x = np.random.default_rng(1).standard_normal(30_000)
    w, at = onsets.cluster_window(x, 20_000, "mid_3_3")
    assert (len(w), at) == (7000, 5000) and abs(w).max() < abs(x).max()
    assert onsets.cluster_window(x, 900, "low_0") is None
    w, at = onsets.cluster_window(x, 1500, "low_0")
    assert (len(w), at) == (3500, 1500)


def test_jobs(spark):
    """Each detection once, in the variant of its band, with a picture and limits of its file."""
    v = physics.d13_d14_band_features(spark, SF).collect()
    assert v and all((r.variant == "lowband") == (r.detection_band == "low") and r.band_power_5 > -200 for r in v)
    assert len({(r.mooring, r.file_number, r.detection_band, r.on_samp) for r in v}) == len(v)
    m = physics.d15_d16_images(spark, SF).collect()
    assert m and all(len(r.image) == r.height * r.width == 64 * 128 and r.low_db < r.high_db for r in m)
    r = physics.d8_to_d10_rescue(spark, SF).collect()
    assert r and all((x.rescue_method == "aic") <= (x.onset_grade != "C") and (x.rescue_shift_s is None or x.rescue_shift_s <= 0) for x in r)
    assert {x.rescue_method for x in r} <= {"aic", "original", "envelope", "kurtosis"}
