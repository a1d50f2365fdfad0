"""Values of operators that SQL does not express, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import location, ml
from tidewatch.plans import physics

SF = "/root/testdata/sf0.001"


def test_combo_correction(spark):
    rng = np.random.default_rng(1)
    sets = ["m1,m2,m3", "m2,m3,m4", "m5,m6", "m1,m6", "m4", "m1,m2,m3,m4"]
    hydro = [(f"A{i}", float(rng.uniform(-63, -62)), float(rng.uniform(-60, -58)), sets[i % len(sets)]) for i in range(24)]
    gt = [("A0", 0.1, -0.2), ("A6", 0.3, 0.4), ("A1", -0.05, 0.02)]
    got = {r.assoc_id: r for r in location.combo_correction(spark.createDataFrame(hydro, "assoc_id string, lat double, lon double, moorings string"), spark.createDataFrame(gt, "assoc_id string, dlat double, dlon double")).collect()}
    by = {h[0]: h[3] for h in hydro}
    known = {}
    for a, y, x in sorted(gt):
        known[by[a]] = -y, -x
    mean = [sum(v[k] for v in known.values()) / len(known) for k in (0, 1)]
    assert len(got) == len(hydro)
    for a, lat, lon, m in hydro:
        own = set(m.split(","))
        sim, name = max(((len(own & set(k.split(","))) / len(own | set(k.split(","))), k) for k in sorted(known, reverse=True)), key=lambda s: (s[0], [-ord(c) for c in s[1]]))
        if sim == 0:
            cy, cx, how = mean[0] / 2, mean[1] / 2, "global_mean"
        else:
            f = 1.0 if sim == 1 else math.sqrt(sim)
            cy, cx, how = known[name][0] * f, known[name][1] * f, "direct" if sim == 1 else f"transfer({name})"
        r = got[a]
        assert r.correction_method == how and (r.lat_corrected, r.lon_corrected) == pytest.approx((lat + cy, lon + cx))
        assert r.correction_km == pytest.approx(math.hypot(cy * 111, cx * 111 * math.cos(math.radians(lat))))


def test_g22_corrects_every_association(spark):
    rows = physics.g22_combo_correction(spark, "/root/testdata/sf0.01").collect()
    assert rows and all(math.isfinite(r.lat_corrected) and r.correction_method.split("(")[0] in ("direct", "transfer", "global_mean") for r in rows)


def test_components(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = np.abs(x @ vt[:2].T)
    got = {r.vec_id: (r.pc1, r.pc2) for r in physics.m2_principal_components(spark, SF).collect()}
    assert s[1] > s[2]
    assert np.abs(np.array([got[r.vec_id] for r in rows]) - want).max() < 1e-3


def test_clusters_and_subclusters(spark):
    """Every row once; a cluster is large enough or noise."""
    n = {r.cluster: r["count"] for r in physics.m3_clusters(spark, SF).groupBy("cluster").count().collect()}
    assert sum(n.values()) == 500 and all(v >= 5 for k, v in n.items() if k != -1)
    sub = physics.m5_subclusters(spark, SF).groupBy("subcluster_id").count().collect()
    assert sum(r["count"] for r in sub) == spark.read.parquet(f"{SF}/embeddings.parquet").where("label = 0").count()
    assert all(r.subcluster_id.startswith("0_") for r in sub)


def test_classifier(spark):
    """Learns what its features say, on rows that it has not seen."""
    r = physics.m7_classifier(spark, SF)
    hits, n = r.agg(F.sum((F.col("truth") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert n > 100 and hits >= 0.9 * n


def test_standardised_array(spark):
    rows = [(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, None)]
    got = {r.id: r.x for r in ml.standardise_array(spark.createDataFrame(rows, "id long, x array<double>"), "x").collect()}
    assert got == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    assert ml.standardise_array(spark.createDataFrame([], "id long, x array<double>"), "x").collect() == []
