"""Running values over parts against loops, whatever the parts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import scans


def rows(seed, n=160):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), rng.randrange(-300, 700), None if rng.random() < 0.2 else rng.randrange(-9, 10)) for i in range(n)]


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 37, 250, 10_000])
def test_running(spark, width):
    data = rows(width)
    df = spark.createDataFrame(data, "id long, k string, t long, v long")
    s = scans.Scan(df, ["k"], ["t", "id"], width)
    for how, name, before in (("sum", "s", False), ("max", "m", True), ("last", "l", False), ("last", "b", True)):
        s = s.running("v", how, name, before)
    s = s.previous("prev", "t", "v")
    got = {r.id: (r.s, r.m, r.l, r.b, tuple(r.prev) if r.prev else None) for r in s.rows().collect()}
    assert len(got) == len(data)
    for own in by_key(data).values():
        for i, r in enumerate(own):
            upto = [x[3] for x in own[: i + 1] if x[3] is not None]
            before = [x[3] for x in own[:i] if x[3] is not None]
            assert got[r[0]] == (sum(upto), max(before, default=None), upto[-1] if upto else None, before[-1] if before else None, (own[i - 1][2], own[i - 1][3]) if i else None)


@pytest.mark.parametrize("keys", [["k"], []])
def test_merged_intervals(spark, keys):
    data = [(k, t, t + abs(v or 0) * 4) for _, k, t, v in rows(5)]
    got = sorted(tuple(r) for r in scans.merge_intervals(spark.createDataFrame(data, "k string, lo long, hi long"), "lo", "hi", keys, 50).select(*keys, "lo", "hi", "n").collect())
    want = []
    for k in sorted({r[0] for r in data}) if keys else [None]:
        runs = []
        for lo, hi in sorted((r[1], r[2]) for r in data if k in (None, r[0])):
            if runs and lo <= runs[-1][1]:
                runs[-1] = [runs[-1][0], max(runs[-1][1], hi), runs[-1][2] + 1]
            else:
                runs.append([lo, hi, 1])
        want += [(*([k] if keys else []), *r) for r in runs]
    assert got == sorted(want)


@pytest.mark.parametrize("width", [1, 60, 5000])
def test_triggers_and_islands(spark, width):
    data = [(i, k, t, v or 0) for i, k, t, v in rows(8)]
    df = spark.createDataFrame(data, "id long, k string, t long, v long")
    got = sorted((r.k, r.on_at, r.off_at) for r in scans.triggers(df, ["k"], ["t", "id"], "v", 5, 0, width).collect())
    islands = {r.id: r.island for r in scans.islands(df, ["k"], ["t", "id"], F.col("t") - F.col("prev.t") > 8, width=width).collect()}
    want = []
    for k, own in by_key(data).items():
        on, run = None, 0
        for i, r in enumerate(own):
            if on is None and r[3] >= 5:
                on = i
            elif on is not None and r[3] <= 0:
                want.append((k, on, i))
                on = None
            run += i > 0 and r[2] - own[i - 1][2] > 8
            assert islands[r[0]] == run
        if on is not None:
            want.append((k, on, len(own) - 1))
    assert got == sorted(want)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_frames(spark, block):
    data = rows(4)
    c = scans.framed(spark.createDataFrame(data, "id long, k string, t long, v long"), ["k"], ["t", "id"], 3, 2, 90, block)
    w = scans.frame(["k"]).rowsBetween(-3, 2)
    got = {r.id: (r.i, r.ids) for r in c.select("id", F.col("_i").alias("i"), "_own", F.collect_list("id").over(w).alias("ids")).where("_own").collect()}
    assert len(got) == len(data)
    for own in by_key(data).values():
        for i, r in enumerate(own):
            assert got[r[0]] == (i, [x[0] for x in own[max(0, i - 3) : i + 3]])


def test_empty(spark):
    df = spark.createDataFrame([], "id long, k string, t long, v long")
    assert scans.islands(df, ["k"], ["t", "id"], F.col("t") > 0).collect() == []
    assert scans.triggers(df, ["k"], ["t", "id"], "v", 5, 0).collect() == []
    assert scans.merge_intervals(df, "t", "v").collect() == []
