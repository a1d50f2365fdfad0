"""Samples drawn again against pandas."""

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import verdicts


def plain(df, cluster, kind, n=30):
    c = df[df.cluster_id == cluster].sort_values("event_id").reset_index(drop=True)
    c["dist"] = np.sqrt((c.x - c.x.mean()) ** 2 + (c.y - c.y.mean()) ** 2)
    n = min(n, len(c))
    if kind == "random":
        return c.event_id.iloc[np.random.default_rng(43).choice(len(c), size=n, replace=False)].tolist()
    bins = min(5, n)
    c["q"] = pd.qcut(c.dist, q=bins, labels=False, duplicates="drop")
    rng, rows = np.random.default_rng(42), []
    for i, (_, own) in enumerate(sorted(c.groupby("q"))):
        k = min(n // bins + (i < n % bins), len(own))
        rows.append(own.iloc[rng.choice(len(own), size=k, replace=False)])
    return pd.concat(rows).sort_values(["dist", "event_id"]).event_id.tolist()


@pytest.mark.parametrize("kind", ["stratified", "random"])
def test_samples(spark, kind):
    rng = np.random.default_rng(9)
    df = pd.DataFrame({"event_id": rng.permutation(700), "cluster_id": rng.choice(["a", "b", "c"], 700, p=[0.6, 0.38, 0.02]), "x": rng.normal(size=700), "y": rng.normal(size=700)})
    df.loc[df.cluster_id == "b", ["x", "y"]] = 0.0  # all at one distance
    df.loc[df.index[df.cluster_id == "b"][:90], "x"] = 3.0
    got = {}
    for r in verdicts.sampled(spark.createDataFrame(df), kind, width=50).collect():
        got.setdefault(r.cluster_id, []).append((r.panel, r.event_id))
    for c in "abc":
        assert [e for _, e in sorted(got[c])] == plain(df, c, kind)
        assert sorted(p for p, _ in got[c]) == list(range(1, len(got[c]) + 1))


def test_judged(spark):
    e = spark.createDataFrame([(i, "a", float(i * 17 % 41), 0.0) for i in range(40)], "event_id long, cluster_id string, x double, y double")
    v = spark.createDataFrame([("a", "random", 3, "r"), ("a", "stratified", 30, "a"), ("a", "random", 31, "a"), ("z", "random", 1, "a")], "cluster_id string, sample string, panel int, verdict string")
    got = {(r.sample, r.panel, r.cluster_id): r.event_id for r in verdicts.judged(e, v).collect()}
    df = e.toPandas()
    assert got == {("random", 3, "a"): plain(df, "a", "random")[2], ("stratified", 30, "a"): plain(df, "a", "stratified")[29], ("random", 31, "a"): None, ("random", 1, "z"): None}
