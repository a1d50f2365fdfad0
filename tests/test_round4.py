"""What larger tables showed: values and sizes that the small ones don't have."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import files, joins, windows


def detections(spark, rows, columns="event_id long, onset_us long, mooring string, snr double"):
    return spark.createDataFrame(rows, columns).withColumn("file_number", F.floor(F.col("onset_us") / 14_400_000_000))


def test_s2_strengths_beyond_16_bits(spark, monkeypatch):
    """a recording's sample holds 16 bits, and a strength above 607.67 has more."""
    snr = [607.68, 29.27, 1e9, -5.0, 0.125, None, math.nan]
    c = detections(spark, [(i, 10**15 + i // 2, "m1", v) for i, v in enumerate(snr)])
    monkeypatch.setattr(files, "catalogue", lambda *_: c)
    got = {r.k: r.value for r in files.s2_samples(spark, "").collect()}
    assert [got[i] for i in range(6)] == [32768.0, -25073.0, 1e11 - 28000, -28500.0, -27987.0, None]
    assert math.isnan(got[6]) and len(got) == 7


def crowd(n, seed, ties=3):
    """References and detections, many at one time."""
    rng = np.random.default_rng(seed)
    ref = [(i, int(rng.integers(0, n // ties)) * 7, f"m{i % 6 + 1}") for i in range(n // 4)]
    det = [(i, int(rng.integers(0, n // ties)) * 7, f"m{int(rng.integers(1, 7))}", None if i % 11 == 0 else float(rng.integers(0, 4)), 1.0) for i in range(n)]
    return ref, det


def pairs_made(df):
    """Join operators of a plan, in which pairs are made."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]


@pytest.mark.parametrize("on", [[], ["m"]])
def test_nearest_without_pairs(spark, on):
    """Rows within the tolerance were all paired first."""
    from tidewatch.operators import rel

    ref, det = crowd(300, 1)
    left = spark.createDataFrame(ref, "ref_id long, ref_us long, m string" if on else "ref_id long, ref_us long, own string")
    right = spark.createDataFrame(det, "event_id long, onset_us long, m string, snr double, d double")
    df = rel.nearest(left, right, "ref_us", "onset_us", 13, ["ref_id"], on=on, tie=["event_id"])
    got = {r.ref_id: r.event_id for r in df.collect()}
    want = {}
    for i, t, m in ref:
        if able := [(abs(d[1] - t), d[1], d[0]) for d in det if abs(d[1] - t) <= 13 and (not on or d[2] == m)]:
            want[i] = min(able)[2]
    assert got == want and want
    assert pairs_made(df) == []


def test_best_of_first_without_pairs(spark):
    """F8: all pairs in the window were sorted and shuffled for the first hundred of each."""
    from tidewatch.operators import rel

    ref, det = crowd(400, 2)
    left, right = spark.createDataFrame(ref, "ref_id long, ref_us long, own string"), spark.createDataFrame(det, "event_id long, onset_us long, m string, snr double, d double")
    df = rel.best_of_first(left, right, "ref_us", "onset_us", 70, 5, "ref_id", F.col("snr") * 2, "event_id")
    want = {}
    for i, t, _ in ref:
        first = sorted(((d[1], d[0], d[3]) for d in det if abs(d[1] - t) <= 70), key=lambda x: x[:2])[:5]
        if first:
            want[i] = min((v is None, v or 0, k) for _, k, v in first)[2]
    assert {r.ref_id: r.event_id for r in df.collect()} == want and want
    assert pairs_made(df) == []


def test_pairs_within_in_batches(spark, monkeypatch):
    """rows went to three buckets each on both sides, and pairs of all stations were made before those that are near enough were kept."""
    from tidewatch.operators import rel

    monkeypatch.setattr(rel, "PAIRS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 900)), f"m{int(rng.integers(1, 4))}") for i in range(400)] + [(900, 5, None), (901, None, "m1")]
    limits = {("m1", "m2"): 9, ("m2", "m1"): 4, ("m1", "m3"): 0}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = rel.pairs_within(spark.createDataFrame(rows, "e long, t long, m string"), "e", "t", "m", limits, ("a", "b", "dt"))
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((x[0], y[0], y[1] - x[1]) for x in rows[:400] for y in rows[:400] if (x[2], y[2]) in limits and 0 <= y[1] - x[1] <= limits[x[2], y[2]])
    assert got and pairs_made(df) == []


def test_j11_frames_open_at_one_end(spark, monkeypatch):
    """a frame up to an hour's end was gone through anew for each row."""
    c = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") * 10**6).alias("onset_us"), F.lit("m1").alias("mooring"), F.when(F.col("id") % 3 == 0, "error").otherwise("x").alias("event_type"), F.lit(1.0).alias("snr"), F.lit(1.0).alias("duration_s"))
    monkeypatch.setattr(joins, "catalogue", lambda *_: c)
    df = joins.j11_unbounded_nearest(spark, "")
    assert {r.ref_id: r.adt for r in df.collect()} == {i: 10**6 for i in range(0, 100, 3)}
    frames = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RangeFrame" in line]
    assert frames and not any("RangeFrame, currentrow$(), unboundedfollowing$()" in line for line in frames)


def test_w17_without_lists(spark, monkeypatch):
    """each event had a list of all of its window's events."""
    rng = np.random.default_rng(4)
    rows = [(i, int(t) * 10**8, f"m{i % 2}") for i, t in enumerate(rng.integers(0, 300, 150))]
    c = spark.createDataFrame(rows, "event_id long, onset_us long, mooring string")
    monkeypatch.setattr(windows, "catalogue", lambda *_: c)
    df = windows.w17_intervals_near_target(spark, "")
    want = {}
    for i, t, m in rows:
        own = sorted(u for _, u, k in rows if k == m and abs(u - t) <= 18 * 10**8)
        want[i] = sum(abs((b - a) / 1e6 - 600) <= 200 for a, b in zip(own, own[1:]))
    assert {r.event_id: r.n_near for r in df.collect()} == want and any(want.values())
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_polygons_count_once(spark, monkeypatch):
    """each of many equal islands was met by each of many equal places."""
    from tidewatch.operators import coast

    corners = ((0.0, 0.0), (0.3, 0.05), (0.25, 0.4), (-0.05, 0.3))
    islands = [(p, k, -62.0 + (p % 3) + a, -60.0 + b) for p in range(60) for k, (a, b) in enumerate(corners)] + [(99, k, -62.0 + 2 * a, -60.0 + 2 * b) for k, (a, b) in enumerate(corners)]
    vertices = spark.createDataFrame(islands, "poly int, seq int, lat double, lon double")
    assert coast.different(coast.edges(vertices)).select("poly").distinct().count() == 4
    seen = []
    real = coast.inside
    monkeypatch.setattr(coast, "inside", lambda points, sides, tile: seen.append((points.count(), sides.count())) or real(points, sides, tile))
    points = [(i, -62.5 + (i % 50) / 20, -60.3 + (i % 25) / 20) for i in range(500)] + [(900, None, -60.0), (901, math.nan, -60.0)]
    got = {r.id: r for r in coast.nearest(spark.createDataFrame(points, "id long, lat double, lon double"), vertices).collect()}
    assert seen == [(50, 16)] and len(got) == 502
    assert got[900].degrees is None and got[901].degrees is None
    for i, y, x in points[:50]:
        sides = [(a, b) for p in (0, 1, 2, 99) for own in [[v[2:] for v in islands if v[0] == p]] for a, b in zip(own, own[1:] + own[:1])]
        within = any(sum((a[0] > y) != (b[0] > y) and x < a[1] + (y - a[0]) / (b[0] - a[0]) * (b[1] - a[1]) for a, b in sides[k : k + 4]) % 2 for k in (0, 4, 8, 12))
        off = []
        for a, b in sides:
            d = b[0] - a[0], b[1] - a[1]
            t = max(0, min(1, ((y - a[0]) * d[0] + (x - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
            off.append(math.hypot(y - a[0] - t * d[0], x - a[1] - t * d[1]))
        for j in range(i, 500, 50):
            assert got[j].degrees == pytest.approx(0.0 if within else min(off), abs=1e-12)


def test_sources_are_located_together():
    """each source went through some tens of thousands of cells for each of its searches, alone."""
    from itertools import combinations

    from tidewatch.functions import geo
    from tidewatch.operators import location

    rng = np.random.default_rng(6)
    g = location.coarse_grid(0.05)
    sources = [{f"m{i + 1}": float(rng.uniform(0, 90)) for i in rng.choice(6, rng.integers(2, 7), replace=False)} for _ in range(40)]
    cell, value = g.search_many(np.array([[o.get(m, np.nan) for m in location.NAMES] for o in sources]), geo.SPEED)
    for o, c, v in zip(sources, cell, value):
        rms = np.sqrt(sum(((g.km[b] - g.km[a]) * 1000 / geo.SPEED - (o[b] - o[a])) ** 2 for a, b in combinations(sorted(o), 2)) / math.comb(len(o), 2))
        assert rms[c] == pytest.approx(rms.min(), abs=1e-9) and v == pytest.approx(rms.min(), abs=1e-9)
    together = location.locate_many(sources, 0.05)
    for o, r in zip(sources, together):
        alone = location.locate(o, 0.05)
        for k, v in alone.items():
            assert r[k] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v)


def test_greedy_takes_the_largest_of_a_slice(monkeypatch):
    """every anchor went through all events of its window one by one, thousands where events are dense."""
    import pandas as pd

    from tidewatch.operators import association

    rng = np.random.default_rng(7)
    pairs, longest = {("m1", "m2"): 5, ("m2", "m1"): 7, ("m2", "m3"): 0}, 9
    for seed in range(20):
        n = 120
        rows = pd.DataFrame({"event_id": rng.permutation(n), "onset_us": np.sort(rng.integers(0, 200, n)), "mooring": rng.choice(["m1", "m2", "m3", "m4"], n), "snr": rng.integers(0, 4, n).astype(float), "band": "low"})
        c = association.Chunk(rows)
        want = []
        for i in range(n):
            best = {}
            for m, j in c.later(i, pairs, longest) if c.free[i] else ():
                if m not in best or c.snr[j] > c.snr[best[m]]:
                    best[m] = j
            if best:
                want.append(c.take([i, *best.values()]))
        with monkeypatch.context() as m:
            m.setattr(association.Chunk, "later", None)
            assert association.greedy(rows, pairs, longest) == want


def test_silhouette_shuffles_no_copies(spark, monkeypatch):
    """every row was sent to every other block, and a few hundred blocks filled the disk."""
    from tidewatch.operators import ml

    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=5).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(200, 9, [1.0] * 5)]
    df = ml.silhouette(spark.createDataFrame(rows, "id long, label int, v array<float>"), "v", "label", "id", 16)
    got = {r.id: r.silhouette for r in df.collect()}
    x, label = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for k, (i, own, _) in enumerate(rows):
        others = [d[k, label == m].mean() for m in set(label.tolist()) - {own}]
        n = int((label == own).sum())
        a = d[k, label == own].sum() / (n - 1) if n > 1 else None
        assert got[i] == pytest.approx(0.0 if a is None else (min(others) - a) / max(a, min(others)), abs=1e-9)
    assert len(got) == len(rows)
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString() and "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["s4_listing", "s12_xlsx_scan", "s2_samples", "s11_npz_scan"])
def test_files_are_made_group_by_group(spark, monkeypatch, query):
    """a batch held the rows of thousands of files as lists."""
    seen = []
    real = files.written_groups

    def spy(rows, *a):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, *a)

    monkeypatch.setattr(files, "written_groups", spy)
    assert getattr(files, query)(spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1 and "collect_list" not in seen[0] and "Aggregate" not in seen[0]


def test_land_events_are_located_together():
    """each event went through its grid alone. Against all cells by the geodesic."""
    from tidewatch.functions import geo
    from tidewatch.operators import location

    rng = np.random.default_rng(9)
    events = [[(str(i), ph, int(rng.integers(1, 50)) * 1_000_000, float(rng.integers(1, 11)) / 10, math.cos(i / 6) - 62.5, math.sin(i / 6) - 59) for i in rng.choice(36, 4, replace=False) for ph in "PS" if rng.random() < 0.9] for _ in range(12)] + [[("a", "P", 1, 0.5, -62.0, -59.0)]]
    got = location.locate_land_many(events, 6.5, 3.75, extent=0.6, coarse=0.05, fine=0.01)
    assert got[-1] is None
    for picks, r in zip(events[:-1], got):
        lat, lon = (np.mean([p[k] for p in picks]) for k in (4, 5))
        t, w = np.array([p[2] for p in picks]) / 1e6, np.array([p[3] for p in picks]) / sum(p[3] for p in picks)
        v = np.array([6.5 if p[1] == "P" else 3.75 for p in picks])
        for reach, step in ((0.6, 0.05), (0.05, 0.01)):
            y, x = (c.ravel()[:, None] for c in np.meshgrid(np.arange(lat - reach, lat + reach + step, step), np.arange(lon - reach, lon + reach + step, step), indexing="ij"))
            km = geo.inverse(y, x, np.array([[p[4] for p in picks]]), np.array([[p[5] for p in picks]]))[0] / 1000
            rest = t - np.hypot(km, 10.0) / v
            spread = np.sqrt((((rest - (rest @ w)[:, None]) ** 2) * w).sum(axis=1))
            k = int(spread.argmin())
            lat, lon = float(y[k, 0]), float(x[k, 0])
        assert r[:2] == pytest.approx((lat, lon)) and r[4] == pytest.approx(float(spread[k])) and r[5:] == (len(picks), len({p[0] for p in picks}))
