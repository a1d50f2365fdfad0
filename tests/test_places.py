"""Layers of depths, coast distance, examples and bias against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import bathymetry, choice, coast, location


def test_layers(spark):
    rng = np.random.default_rng(1)
    grids = {"low": (1, 0.0, 0.0, 0.5, 0.25, rng.normal(size=(9, 13))), "high": (2, 1.0, 0.5, 0.125, 0.125, rng.normal(size=(11, 7)))}
    grids["high"][5][3:6, 2:4] = np.nan
    layers = spark.createDataFrame([(k, p, a, b, c, d, *z.shape) for k, (p, a, b, c, d, z) in grids.items()], bathymetry.LAYERS)
    cells = spark.createDataFrame([(k, i, j, float(z[i, j])) for k, (*_, z) in grids.items() for i in range(z.shape[0]) for j in range(z.shape[1])], "layer string, i int, j int, z double")
    points = [(n, float(y), float(x)) for n, (y, x) in enumerate(rng.uniform(-0.2, 4.3, (300, 2)))] + [(900, 4.0, 3.0), (901, 0.0, 0.0), (902, 2.25, 1.25), (903, None, 1.0)]
    got = {r.id: (r.layer, r.z) for r in bathymetry.at_points(spark.createDataFrame(points, "id long, lat double, lon double"), layers, cells, 4).collect()}
    assert len(got) == len(points)
    for n, y, x in points:
        want = (None, None)
        for k, (_, a, b, c, d, z) in grids.items() if y is not None else ():
            u, v = (y - a) / c, (x - b) / d
            if 0 <= u <= z.shape[0] - 1 and 0 <= v <= z.shape[1] - 1:
                i, j = min(int(u), z.shape[0] - 2), min(int(v), z.shape[1] - 2)
                u, v = u - i, v - j
                s = z[i, j] * (1 - u) * (1 - v) + z[i + 1, j] * u * (1 - v) + z[i, j + 1] * (1 - u) * v + z[i + 1, j + 1] * u * v
                want = want if math.isnan(s) else (k, s)
        assert got[n][0] == want[0] and (want[1] is None or got[n][1] == pytest.approx(want[1]))
    assert {k for k, _ in got.values()} == {None, "low", "high"}


def test_coast(spark):
    square = [(1, k, y, x) for k, (y, x) in enumerate(((-62.0, -60.0), (-62.0, -59.0), (-63.0, -59.0), (-63.0, -60.0)))]
    far = [(2, 0, -70.0, -80.0), (2, 1, -70.1, -80.0), (2, 2, -70.1, -79.9)]
    vertices = spark.createDataFrame(square + far, "poly int, seq int, lat double, lon double")
    located = [(1, -62.5, -59.5, "A", "icequake"), (2, -62.5, -58.0, "B", "icequake"), (3, -62.5, -58.0, "B", "icequake"), (4, -62.5, -58.9, "C", "icequake"), (5, -62.5, -58.0, "A", "tphase"), (6, -62.5, -58.0, "D", "icequake"), (7, None, None, "A", "icequake"), (8, -61.0, -40.0, "A", "icequake")]
    df = spark.createDataFrame(located, "id long, lat double, lon double, quality_tier string, event_class string")
    ice = spark.createDataFrame([(3, 0.2), (8, float("nan"))], "id long, sea_ice_conc double")
    got = {r.id: r for r in coast.ice_rule(df, vertices, ice).collect()}
    assert {i for i, r in got.items() if r.icequake_filtered} == {2, 8} == {i for i, r in got.items() if r.event_class == "unclassified"}
    near = {1: (-62.5, -59.5), 2: (-62.5, -59.0), 3: (-62.5, -59.0), 4: (-62.5, -59.0), 5: (-62.5, -59.0), 8: (-62.0, -59.0)}
    for i, (y, x) in near.items():
        _, lat, lon, *_ = located[i - 1]
        assert got[i].dist_to_coast_km == pytest.approx(float(geo.inverse(lat, lon, y, x)[0]) / 1000, abs=1e-6)
    assert got[6].dist_to_coast_km is None and got[7].dist_to_coast_km is None
    none = coast.ice_rule(df, vertices.limit(0)).collect()
    assert len(none) == 8 and not any(r.icequake_filtered for r in none)


@pytest.mark.parametrize("n", [3, 23, 24, 130])
def test_examples(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.choice(["a", "b"]).item(), rng.choice(["m1", "m2", "m3"], p=[0.7, 0.2, 0.1]).item(), float(rng.integers(0, 40)) / 2) for i in range(2 * n)]
    got = {}
    for r in choice.one_per_slice(spark.createDataFrame(rows, "id long, kind string, m string, v double"), "kind", "v", "m", "id").collect():
        got.setdefault(r.kind, []).append((r.pick, r.id))
    for kind in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == kind), key=lambda r: (-r[3], r[0]))
        want, seen = own[:6], set()
        if len(own) >= 24:
            want = []
            for q in range(6):
                part = own[q * (len(own) // 6) : (q + 1) * (len(own) // 6)]
                one = next((r for r in part if r[2] not in seen), part[0])
                seen.add(one[2])
                want.append(one)
        assert sorted(got[kind]) == [(k + 1, r[0]) for k, r in enumerate(want)]


def test_bias(spark, monkeypatch):
    rng = np.random.default_rng(3)
    hydro = [(str(i), float(rng.uniform(-64, -61)), float(rng.uniform(-61, -57))) for i in range(40)] + [("null", None, -59.0)]
    gt = [tuple(map(float, (rng.uniform(-64, -61), rng.uniform(-61, -57), *rng.normal(0, 0.05, 2)))) for _ in range(30)]
    monkeypatch.setattr(location, "GT_BLOCK", 7)
    got = {r.assoc_id: r for r in location.bias_correction(spark.createDataFrame(hydro, "assoc_id string, lat double, lon double"), spark.createDataFrame(gt, "lat_seis double, lon_seis double, dlat double, dlon double")).collect()}
    for a, y, x in hydro[:-1]:
        w = [1 / (float(geo.inverse(y, x, g[0], g[1])[0]) / 1000 + 20) ** 2 for g in gt]
        dy, dx = (sum(v * g[k] for v, g in zip(w, gt)) / sum(w) for k in (2, 3))
        r = got[a]
        assert (r.lat_corrected, r.lon_corrected, r.correction_dlat) == pytest.approx((y - dy, x - dx, -dy), abs=1e-7)
        assert r.correction_km == pytest.approx(math.hypot(dy * 111, dx * 111 * math.cos(math.radians(y))), abs=1e-4)
    assert got["null"].lat_corrected is None and len(got) == 41


def test_residual_vectors(spark):
    """The offset and its azimuth, on the ellipsoid."""
    a = spark.createDataFrame([("x", -62.0, -59.0)], "assoc_id string, lat double, lon double")
    b = spark.createDataFrame([("x", -62.5, -58.0)], "assoc_id string, lat double, lon double")
    r = location.residual_vectors(a, b).select("dlat", "dlon", "offset_km", "offset_azimuth", F.lit(1)).first()
    m, az = geo.inverse(-62.0, -59.0, -62.5, -58.0)
    assert (r.dlat, r.dlon, r.offset_km, r.offset_azimuth) == pytest.approx((-0.5, 1.0, float(m) / 1000, float(az)))
