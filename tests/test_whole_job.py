"""Plans give what the whole job gives: production grids, and all seeds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.plans import physics

#: On no cell of a grid of 0.05 degrees, and more than a fine search's margin off the nearest one.
SOURCE = -62.4712, -58.6231


def heard(spark, km):
    """A catalogue of one event at SOURCE, a detection at each station."""
    rows = [(i, 1_000_000_000 + round(km(y, x) * 1e9 / geo.SPEED), m, "low", 9.0) for i, (m, y, x, _) in enumerate(geo.STATIONS)]
    return spark.createDataFrame(rows, "event_id long, onset_us long, mooring string, band string, snr double")


def test_g6_grid(spark, monkeypatch):
    wide = 111.0 * math.cos(math.radians(-62.5))
    c = heard(spark, lambda y, x: math.hypot((SOURCE[0] - y) * 111.0, (SOURCE[1] - x) * wide))
    monkeypatch.setattr(physics, "catalogue", lambda *_: c)
    seen = {}
    real = physics.association.associate
    monkeypatch.setattr(physics.association, "associate", lambda *a, **k: seen.update(k) or real(*a, **k))
    (r,) = physics.g6_pruned_association(spark, "").collect()
    assert r.n_moorings == len(geo.STATIONS)
    assert seen.get("step", physics.association.STEP) == 0.01
    found = real(c, spatial=True, prefix="T", digits=7).first()
    assert (r.lat, r.lon) == (found.lat, found.lon)
    assert abs(r.lat - SOURCE[0]) <= 0.0101 and abs(r.lon - SOURCE[1]) <= 0.0101


def test_g7_grid(spark, monkeypatch):
    c = heard(spark, lambda y, x: float(geo.inverse(*SOURCE, y, x)[0]) / 1000)
    monkeypatch.setattr(physics, "catalogue", lambda *_: c)
    (r,) = physics.g7_to_g13_location(spark, "").collect()
    want = physics.location.locate({m: t / 1e6 for m, t in ((e.mooring, e.onset_us) for e in c.collect())}, 0.01)
    assert r.n_moorings == len(geo.STATIONS)
    assert (r.lat, r.lon, r.jackknife_shift_km) == pytest.approx((want["lat"], want["lon"], want["jackknife_shift_km"]))


def test_g19_grid(spark, monkeypatch):
    rng = np.random.default_rng(1)
    at = -62.4437, -58.9712
    rows = []
    for order in range(3):
        for supp in rng.permutation(36)[:6].tolist():
            ring = math.radians(supp * 10.0)
            km = float(geo.inverse(*at, math.cos(ring) - 62.5, math.sin(ring) - 59.0)[0]) / 1000
            rows.append((order, supp, "A", 5.0 + math.hypot(km, 10.0) / 6.5, 0.0))
    items = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double")
    monkeypatch.setattr(physics, "table", lambda *_: items)
    got = physics.g19_land_location(spark, "").collect()
    assert len(got) == 3
    assert all(abs(r.lat - at[0]) <= 0.003 and abs(r.lon - at[1]) <= 0.003 for r in got)


def test_m4_seeds(spark):
    got = physics.m4_stability(spark, "/root/testdata/sf0.001").agg(F.collect_set("seed")).first()[0]
    assert len(got) == 5
