"""Association, location and onset picks against plain versions that go through everything."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tidewatch.functions import geo
from tidewatch.operators import association, location, onsets
from tidewatch.plans import physics

PAIRS = {(x, y): round(p[4] * 1e6) for p in geo.pair_table() for x, y in ((p[0], p[1]), (p[1], p[0]))}
LONGEST = max(PAIRS.values())
NAMES = [c.split()[0] for c in association.SCHEMA.split(", ")]


def events(n, seed, spacing_us=9_000_000):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"event_id": rng.permutation(n), "onset_us": np.sort(rng.integers(0, n * spacing_us, n)), "mooring": [f"m{i}" for i in rng.integers(1, 7, n)], "snr": rng.integers(1, 30, n).astype(float), "band": rng.choice(["low", "mid"], n)})


def plain(rows, step=None):
    """Associations as sets of event ids, from the definitions, cell by cell where step is given."""
    e = rows.sort_values(["onset_us", "event_id"]).to_dict("records")
    if step:
        wide = 111.0 * math.cos(math.radians(-62.5))
        ys, xs = ([s[k] for s in geo.STATIONS] for k in (1, 2))
        cells = [(y, x) for y in np.arange(min(ys) - 1, max(ys) + 1, step) for x in np.arange(min(xs) - 1, max(xs) + 1, step)]
        times = [{m: math.hypot((y - a) * 111.0, (x - o) * wide) * 1000 / geo.SPEED for m, a, o, _ in geo.STATIONS} for y, x in cells]
        tol = math.hypot(step * 111.0, step * wide) / 2 * 1000 / geo.SPEED + 4.0
    free, out = set(range(len(e))), []
    for i, a in enumerate(e):
        if i not in free:
            continue
        near = {}
        for j in sorted(free):
            b = e[j]
            if j > i and b["mooring"] != a["mooring"] and b["onset_us"] - a["onset_us"] <= PAIRS[a["mooring"], b["mooring"]]:
                near.setdefault(b["mooring"], []).append(j)
        if not step:
            members = [i, *(min(own, key=lambda j: (-e[j]["snr"], j)) for own in near.values())]
            least, where = 2, None
        else:
            members, able = [i], range(len(cells))
            for m in sorted(near, key=lambda m: (len(near[m]), near[m][0])) if len(near) > 1 else []:
                for j in sorted(near[m], key=lambda j: (-e[j]["snr"], j)):
                    left = [c for c in able if all(abs(times[c][m] - times[c][e[k]["mooring"]] - (e[j]["onset_us"] - e[k]["onset_us"]) / 1e6) <= tol for k in members)]
                    if left:
                        members.append(j)
                        able = left
                        break
            least = 3
            if len(members) >= least:
                rms = [math.sqrt(np.mean([(times[c][e[q]["mooring"]] - times[c][e[p]["mooring"]] - (e[q]["onset_us"] - e[p]["onset_us"]) / 1e6) ** 2 for p, q in combinations(members, 2)])) for c in able]
                where = (*cells[able[int(np.argmin(rms))]], min(rms))
        if len(members) >= least:
            free -= set(members)
            out.append((frozenset(e[j]["event_id"] for j in members), where))
    return out


def ids(row):
    return frozenset(map(int, row["event_ids"].split(",")))


def test_greedy():
    for seed in range(4):
        rows = events(250, seed)
        got = [ids(dict(zip(NAMES, r))) for r in association.greedy(rows, PAIRS, LONGEST)]
        assert got == [s for s, _ in plain(rows)]


def test_pruned():
    rows = events(220, 7)
    got = [dict(zip(NAMES, r)) for r in association.pruned(rows, PAIRS, LONGEST, step=0.1)]
    want = plain(rows, 0.1)
    assert [ids(r) for r in got] == [s for s, _ in want] and len(want) > 20
    for r, (_, where) in zip(got, want):
        assert (r["lat"], r["lon"], r["residual_s"]) == pytest.approx(where, abs=1e-6)


@pytest.mark.parametrize("spatial", [False, True])
def test_associate_in_chunks(spark, spatial):
    """Cut into chunks over several tasks and batches the catalogue gives what it gives as a whole."""
    rows = events(2000, 3, 60_000_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = association.associate(spark.createDataFrame(rows), spatial=spatial, step=0.1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = [rows[rows.band == b] for b in ("low", "mid")] if spatial else [rows]
    want = [ids(dict(zip(NAMES, r))) for p in parts for r in (association.pruned(p, PAIRS, LONGEST, 0.1) if spatial else association.greedy(p, PAIRS, LONGEST))]
    assert sorted(sorted(ids(r.asDict())) for r in got) == sorted(map(sorted, want))
    assert [r.assoc_id for r in sorted(got, key=lambda r: (r.earliest_us, r.event_ids))] == [f"A{i:06}" for i in range(len(got))]


def test_locate():
    """Blocks leave out no cell that could be best: coarse place and jackknife as by the pairs of all cells."""
    rng = np.random.default_rng(5)
    g = location.coarse_grid(0.05)
    for _ in range(12):
        o = {f"m{i + 1}": float(rng.uniform(0, 80)) for i in rng.choice(6, rng.integers(2, 7), replace=False)}

        def search(part):
            rms = np.sqrt(sum(((g.km[b] - g.km[a]) * 1000 / geo.SPEED - (part[b] - part[a])) ** 2 for a, b in combinations(sorted(part), 2)) / math.comb(len(part), 2))
            return int(rms.argmin()), float(rms.min())

        assert g.search(o, geo.SPEED) == (search(o)[0], pytest.approx(search(o)[1]))
        found = location.locate(o, 0.05)
        used = {m: t for m, t in o.items() if m != found["dropped_mooring"]}
        k, _ = search(used)
        assert abs(found["lat"] - g.lat[k]) <= 0.016 and abs(found["lon"] - g.lon[k]) <= 0.016 and found["n_moorings"] == len(used)
        shifts = [float(geo.inverse(found["lat"], found["lon"], g.lat[j], g.lon[j])[0]) / 1000 for j in (search({a: t for a, t in used.items() if a != m})[0] for m in used)] if len(used) >= 4 else [0.0]
        assert found["jackknife_shift_km"] == pytest.approx(max(shifts))
    assert location.locate({"m1": 0.0}, 0.05) is None


def test_arcs():
    rng = np.random.default_rng(6)
    for south, north in ((-66, -58), (-85, -80), (-4, 4)):
        a, b = (np.stack([rng.uniform(south, north, n), rng.uniform(-64, -54, n)]) for n in (1500, 20))
        exact = geo.inverse(a[0][:, None], a[1][:, None], b[0][None], b[1][None])[0] / 1000
        assert (np.abs(location.arcs(*a, *b) - exact) <= 1e-6 + exact * location._ARC_ERROR * np.maximum(1, exact / 1000) ** 2).all()


def test_land():
    rng = np.random.default_rng(8)
    for _ in range(6):
        picks = [(str(i), ph, int(rng.integers(1, 50)) * 1_000_000, float(rng.integers(1, 11)) / 10, math.cos(i / 6) - 62.5, math.sin(i / 6) - 59) for i in rng.choice(36, 4, replace=False) for ph in "PS" if rng.random() < 0.9]
        lat, lon = (np.mean([p[k] for p in picks]) for k in (4, 5))
        t = np.array([p[2] for p in picks]) / 1e6
        w = np.array([p[3] for p in picks]) / sum(p[3] for p in picks)
        v = np.array([6.5 if p[1] == "P" else 3.75 for p in picks])
        for reach, step in ((1.0, 0.05), (0.05, 0.005)):
            y, x = (c.ravel()[:, None] for c in np.meshgrid(np.arange(lat - reach, lat + reach + step, step), np.arange(lon - reach, lon + reach + step, step), indexing="ij"))
            km = geo.inverse(y, x, np.array([[p[4] for p in picks]]), np.array([[p[5] for p in picks]]))[0] / 1000
            rest = t - np.hypot(km, 10.0) / v
            spread = np.sqrt((((rest - (rest @ w)[:, None]) ** 2) * w).sum(axis=1))
            k = int(spread.argmin())
            lat, lon = float(y[k, 0]), float(x[k, 0])
        got = location.locate_land(picks, 6.5, 3.75, extent=1.0, coarse=0.05, fine=0.005)
        assert got[:2] == pytest.approx((lat, lon)) and got[4] == pytest.approx(float(spread[k])) and got[2] == pytest.approx(float(rest[k] @ w) * 1e6, abs=2)
    assert location.locate_land(picks[:2], 6.5, 3.75) is None


def burst(at, n=9000, size=20.0, seed=1):
    x = np.random.default_rng(seed).standard_normal(n)
    k = np.arange(n - at)
    x[at:] += size * np.sin(0.4 * k) * np.exp(-k / 700)
    return x


def test_picks_find_an_onset():
    for at in (5600, 6500, 7300):
        x = burst(at)
        for pick in (onsets.aic_pick(x**2), onsets.envelope_pick(x), onsets.kurtosis_z_pick(x)):
            assert abs(pick.at - at) < 200 and 0 < pick.quality <= 1
        assert abs(onsets.kurtosis_gradient_pick(np.abs(x), 500).at + 500 - at) < 400
    quiet = np.zeros(9000)
    assert onsets.envelope_pick(quiet) == onsets.NO_PICK and onsets.kurtosis_z_pick(quiet) == onsets.NO_PICK
    assert onsets.envelope_pick(quiet[:100]) == onsets.NO_PICK and onsets.aic_pick(quiet) == (4500, 0.0)


def test_rise():
    """Against a walk over the samples."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        x, hold = rng.integers(0, 6, rng.integers(1, 40)), int(rng.integers(1, 4))
        tops = [i for i in range(len(x) - hold + 1) if all(x[i : i + hold] >= 4)]
        want = None
        if tops:
            begin = tops[0]
            while begin > 0 and x[begin - 1] >= 2:
                begin -= 1
            want = begin, tops[0]
        assert onsets.rise(x, 4, 2, hold) == want


def test_rescue():
    x = burst(6300)
    assert onsets.rescue(x, 6500, 0.8, "A") == ("aic", None, 0.8)
    method, shift, quality = onsets.rescue(x, 6500, 0.2, "C")
    assert method in ("envelope", "kurtosis") and -0.5 < shift <= 0 and quality >= onsets.RESCUE_OK
    assert onsets.rescue(x, 6000, 0.2, "C")[0] == "original"  # the picks are late
    assert onsets.rescue(np.zeros(9000), 5000, 0.1, "C") == ("original", None, 0.1)


def test_queries_number_their_rows(spark):
    got = physics.g3_greedy_association(spark, "/root/testdata/sf0.001").collect()
    assert len({r.assoc_id for r in got}) == len(got) > 0
    used = [i for r in got for i in r.event_ids.split(",")]
    assert len(used) == len(set(used)) and all(r.n_events == len(r.event_ids.split(",")) >= 2 for r in got)
