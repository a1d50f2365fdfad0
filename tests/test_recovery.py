"""Recovered picks against a walk over all picks, and the search around a place against all cells."""

import numpy as np
from test_physics import LONGEST, PAIRS

from tidewatch.functions import geo
from tidewatch.operators import recovery
from tidewatch.operators.location import fine_search

NAMES = [s[0] for s in geo.STATIONS]


def sources(n, seed, spacing=40):
    """Sources close in time, heard at three stations, and picks of all stations around."""
    rng = np.random.default_rng(seed)
    located, arrivals, picks = [], [], []
    for i in range(n):
        t0, lat, lon = 1_000 + i * spacing, float(rng.uniform(-63, -62)), float(rng.uniform(-60, -57.5))
        km = {m: float(geo.inverse(lat, lon, y, x)[0]) / 1000 for m, y, x, _ in geo.STATIONS}
        own = sorted(rng.choice(NAMES, 3, replace=False).tolist())
        located.append((f"A{i}", lat, lon, 0.5, rng.choice(["A", "B", "D"], p=[0.5, 0.3, 0.2]).item(), 3 if rng.random() < 0.9 else 4))
        for m in NAMES:
            t = round((t0 + km[m] * 1000 / geo.SPEED + rng.normal(0, 0.3)) * 1e6)
            if m in own:
                arrivals.append((f"A{i}", m, t))
            elif rng.random() < 0.7:
                picks.append((len(picks), m, t, float(rng.integers(1, 6))))
    picks += [(len(picks) + k, rng.choice(NAMES).item(), int(rng.integers(1_000_000_000, (1_000 + n * spacing) * 10**6)), v) for k, v in enumerate(rng.choice([3.0, 4.0, -2.0, float("nan")], 40).tolist())]
    return located, arrivals, picks


def plain(located, arrivals, picks):
    """For each association and missing station the candidates, strongest first."""
    out = {}
    for a, _, _, _, tier, n in located:
        if tier == "D" or n != 3:
            continue
        own = {m: t // 10**6 * 10**6 for x, m, t in arrivals if x == a}
        for m in set(NAMES) - set(own):
            lo, hi = max(t - PAIRS[o, m] for o, t in own.items()), min(t + PAIRS[o, m] for o, t in own.items())
            able = [(-s, t, e) for e, k, t, s in picks if k == m and lo <= t // 10**6 * 10**6 < hi and s > -1]
            out[a, m] = (sorted(able), (lo + hi) // 2)
    return out


def frames(spark, located, arrivals, picks):
    return (
        spark.createDataFrame(located, "assoc_id string, lat double, lon double, residual_s double, quality_tier string, n_moorings int"),
        spark.createDataFrame(arrivals, "assoc_id string, mooring string, onset_us long"),
        spark.createDataFrame(picks, "event_id long, mooring string, onset_us long, snr double"),
    )


def test_recovered(spark):
    data = sources(30, 1)
    want = {}
    for (a, m), (able, _) in plain(*data).items():
        want.setdefault(a, {})
        if able:
            want[a][m] = able[0][1]
    rows = {r.assoc_id: r for r in recovery.recover(*frames(spark, *data)).collect()}
    assert set(rows) == set(want) and any(want.values())
    where = {x[0]: x for x in data[0]}
    for a, r in rows.items():
        _, lat, lon, rms, *_ = where[a]
        assert (r.orig_lat, r.orig_lon, r.orig_residual) == (lat, lon, rms)
        assert r.n_recovered == len(want[a]) and r.new_n_moorings == 3 + len(want[a])
        assert r.recovered_moorings == (",".join(sorted(want[a])) or None)
        if not want[a]:
            assert (r.new_lat, r.new_lon, r.new_residual) == (lat, lon, rms)
    for a in [a for a in rows if want[a]][:4]:
        onsets = {m: t // 10**6 for x, m, t in data[1] if x == a} | {m: t // 10**6 for m, t in want[a].items()}
        y, x, f = fine_search(where[a][1], where[a][2], onsets, geo.SPEED, recovery.PAD)
        k = int(f.argmin())
        assert abs(rows[a].new_lat - y.ravel()[k]) < 1e-9 and abs(rows[a].new_lon - x.ravel()[k]) < 1e-9


def test_one_to_one(spark):
    data = sources(30, 2, 8)
    slots = plain(*data)
    # plain stable matching: windows ask in their order, picks keep the nearest
    asks = {k: [(e, abs(t // 10**6 * 10**6 - mid)) for _, t, e in able] for k, (able, mid) in slots.items()}
    held, at, free = {}, dict.fromkeys(asks, 0), sorted(asks)
    while free:
        k = free.pop()
        while at[k] < len(asks[k]):
            e, off = asks[k][at[k]]
            at[k] += 1
            if e not in held or (off, k[0]) < held[e][:2]:
                if e in held:
                    free.append(held[e][2])
                held[e] = off, k[0], k
                break
    located, arrivals, picks = frames(spark, *data)
    found = recovery.candidates(recovery.windows(arrivals.join(located.where("quality_tier <> 'D' AND n_moorings = 3"), "assoc_id", "left_semi"), geo.pair_windows(spark)), picks, LONGEST)
    got = recovery.one_to_one(found).collect()
    assert {(r.assoc_id, r.mooring): r.event_id for r in got} == {k: e for e, (_, _, k) in held.items()}
    assert len({r.event_id for r in got}) == len(got) < len(recovery.strongest(found).collect())


def test_none(spark):
    located, arrivals, picks = frames(spark, [("A0", None, None, None, "A", 3)], [("A0", m, 10**9) for m in NAMES[:3]], [(1, "m5", 10**9, 4.0)])
    (r,) = recovery.recover(located, arrivals, picks).collect()
    assert (r.new_lat, r.new_residual, r.n_recovered, r.recovered_moorings) == (None, None, 0, None)
    assert recovery.recover(located.limit(0), arrivals, picks).collect() == []
