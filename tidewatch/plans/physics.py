"""Waveforms, association, location and learning on what the tables can stand in for."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import association, density, detection, location, manifold, ml, recovery
from ..shared import keep, shared_folder
from ..sources import dat
from ..sources.files import listing, written
from ..sources.tables import catalogue, table
from .registry import plan


def _sounds(spark, sf):
    """Recordings written as files: a minute and a half for each station and day, noise and a burst for each loud event at the second of its hour's end."""
    import numpy as np
    import pandas as pd

    loud = catalogue(spark, sf).where("snr > 100").withColumn("day", F.floor(F.col("onset_us") / 86_400_000_000))
    per = loud.groupBy("mooring", "day").agg(F.array_sort(F.collect_list(F.struct("onset_us", "snr", "duration_s"))).alias("bursts"))

    def make(frames):
        for f in frames:
            for m, d, b in zip(f["mooring"], f["day"], f["bursts"]):
                rng = np.random.default_rng(int(d) * 10 + int(m[1:]))
                x = rng.standard_normal(150_000)
                t = np.arange(1500) / 1000
                for e in b:
                    at = 65_000 + int(e["onset_us"] // 1_000_000 % 80) * 1000
                    x[at : at + 1500] += e["snr"] / 4 * np.sin(2 * np.pi * (4 + e["duration_s"] / 3) * t) * np.exp(-2 * t)
                start = datetime(1970, 1, 1) + timedelta(days=int(d))
                yield pd.DataFrame({"name": [f"{m}/{d:08d}.DAT"], "content": [dat.encode(start, x * 64, instrument_id=m.upper(), sample_rate=1000)]})

    folder = f"{shared_folder(spark)}/sounds-{uuid.uuid4().hex}"
    written(per.mapInPandas(make, "name string, content binary"), folder)
    return listing(spark, folder, "*.DAT")


@plan()
def d1_to_d12_detection(spark, sf):
    """Filters, ratios, triggers, onsets and all features of files."""
    return detection.numbered(detection.catalogue(_sounds(spark, sf)))


@plan()
def d8_to_d10_rescue(spark, sf):
    """Envelope and kurtosis picks of detections whose onset is poor, in their cluster's filter."""
    return detection.rescued(_sounds(spark, sf), {"low": "low_0", "mid": "mid_0"})


@plan()
def d13_d14_band_features(spark, sf):
    return detection.variants(_sounds(spark, sf))


@plan()
def d15_d16_images(spark, sf):
    return detection.images(_sounds(spark, sf))


@plan(f"h AS (SELECT mooring, count(*) AS n FROM cat GROUP BY mooring) SELECT m1, m2, max_us, a.n AS n1, b.n AS n2 FROM ({geo.PAIR_WINDOWS_SQL}) JOIN h a ON a.mooring = m1 JOIN h b ON b.mooring = m2 WHERE m1 < m2")
def g1_travel_times(spark, sf):
    """The windows of the pairs of stations that the catalogue has, and how much each has heard."""
    heard = catalogue(spark, sf).groupBy("mooring").agg(F.count("*").alias("n"))
    one, other = (heard.select(F.col("mooring").alias(f"m{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    return geo.pair_windows(spark).where("m1 < m2").join(one, "m1").join(other, "m2").select("m1", "m2", "max_us", "n1", "n2")


@plan("SELECT m.mooring AS m1, o.mooring AS m2, 120000000 AS max_us FROM (SELECT DISTINCT mooring FROM cat) m JOIN (SELECT DISTINCT mooring FROM cat) o ON m.mooring < o.mooring")
def g2_fallback_windows(spark, sf):
    """Pairs without a model have two minutes."""
    m = catalogue(spark, sf).select("mooring").distinct()
    pairs = m.select(F.col("mooring").alias("m1")).join(F.broadcast(m.select(F.col("mooring").alias("m2"))), F.col("m1") < F.col("m2"))
    model = geo.pair_windows(spark, [])
    return pairs.join(model, ["m1", "m2"], "left").select("m1", "m2", F.coalesce("max_us", F.lit(int(geo.FALLBACK_S * 1e6))).alias("max_us"))


@plan()
def g3_greedy_association(spark, sf):
    return association.associate(catalogue(spark, sf)).select("assoc_id", "n_moorings", "moorings", "n_events", "event_ids", "earliest_us", "latest_us", "dt_s", "detection_band")


@plan()
def g4_resumable_association(spark, sf):
    """The greedy association in committed steps, stopped after two of them and gone on with."""
    path = f"{shared_folder(spark)}/association-{uuid.uuid4().hex}"
    c = catalogue(spark, sf)
    found = association.associate_resumable(c, path, stop_after=2)
    if found is None:
        found = association.associate_resumable(c, path)
    return found.select("assoc_id", "n_moorings", "moorings", "n_events", "event_ids", "earliest_us", "latest_us", "dt_s", "detection_band")


@plan()
def g6_pruned_association(spark, sf):
    return association.associate(catalogue(spark, sf), spatial=True, prefix="T", digits=7)


def _arrivals(spark, sf):
    a = association.associate(catalogue(spark, sf))
    x = a.select("assoc_id", F.explode(F.split("event_ids", ",").cast("array<long>")).alias("event_id"))
    return x.join(catalogue(spark, sf).select("event_id", "mooring", "onset_us"), "event_id").select("assoc_id", "mooring", "onset_us")


@plan()
def g7_to_g13_location(spark, sf):
    """Coarse and fine search, outlier, jackknife, tier and uncertainty of all associations."""
    return location.locate_associations(_arrivals(spark, sf))


def _recovered(spark, sf, exclusive):
    # events twenty times as dense as they are, so that stations share sources
    c = keep(catalogue(spark, sf).withColumn("onset_us", F.expr("onset_us div 20")))
    a = association.associate(c).select("assoc_id", F.explode(F.split("event_ids", ",").cast("array<long>")).alias("event_id"))
    x = keep(a.join(c.select("event_id", "mooring", "onset_us"), "event_id").select("assoc_id", "mooring", "onset_us"))
    three = x.join(x.groupBy("assoc_id").count().where("count = 3"), "assoc_id", "left_semi")
    return recovery.recover(location.locate_associations(three), x, c, exclusive)


@plan()
def g18_pick_recovery(spark, sf):
    """The strongest pick of each missing station in the window that all picks of an association leave, and the place with it."""
    return _recovered(spark, sf, False)


@plan()
def g18_one_to_one_recovery(spark, sf):
    """The same with each pick in one association at most."""
    return _recovered(spark, sf, True)


@plan()
def g19_land_location(spark, sf):
    """Lineitems as phase picks of stations on a circle."""
    ring = F.radians(F.col("l_suppkey") % 36 * 10.0)
    picks = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("assoc_id"), F.col("l_suppkey").cast("string").alias("station"), F.when(F.col("l_returnflag") == "A", "P").otherwise("S").alias("phase"), (F.col("l_quantity") * 1_000_000).cast("long").alias("pick_us"), (F.col("l_discount") + 0.1).alias("probability"), (F.cos(ring) - 62.5).alias("station_lat"), (F.sin(ring) - 59.0).alias("station_lon"))
    return location.locate_land_events(picks)


@plan("""h AS (SELECT n_nationkey AS k, 'a' || n_nationkey AS assoc_id, n_nationkey * 0.01::DOUBLE - 62 AS la, n_regionkey * 0.1::DOUBLE - 59 AS lo FROM nation) SELECT assoc_id, round(la - (la + 0.01::DOUBLE * (k % 3)), 6) AS dlat, round(lo - (lo - 0.02::DOUBLE), 6) AS dlon FROM h""")
def g20_residual_vectors(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("assoc_id"), (F.col("n_nationkey") * 0.01 - 62).alias("lat"), (F.col("n_regionkey") * 0.1 - 59).alias("lon"), "n_nationkey")
    seismic = n.select("assoc_id", (F.col("lat") + 0.01 * (F.col("n_nationkey") % 3)).alias("lat"), (F.col("lon") - 0.02).alias("lon"))
    return location.residual_vectors(seismic, n).select("assoc_id", F.round("dlat", 6).alias("dlat"), F.round("dlon", 6).alias("dlon"))


@plan()
def g22_combo_correction(spark, sf):
    a = association.associate(catalogue(spark, sf)).select("assoc_id", (F.col("dt_s") / 100 - 62.5).alias("lat"), (F.col("n_events") - 60.0).alias("lon"), "moorings")
    gt = a.where("pmod(xxhash64(assoc_id), 200) = 0").select("assoc_id", F.lit(0.02).alias("dlat"), (F.col("lon") / 1000).alias("dlon"))
    return location.combo_correction(a, gt)


_ARR = "x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@plan(f"{_ARR}, s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM x GROUP BY i) SELECT vec_id, CAST(x.i - 1 AS BIGINT) AS i, round((v - m) / d, 4) AS z FROM x JOIN s USING (i)")
def m1_standardise(spark, sf):
    """All components."""
    z = ml.standardise_array(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return z.select("vec_id", F.posexplode("embedding").alias("i", "z")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("z", 4).alias("z"))


@plan()
def m2_principal_components(spark, sf):
    return ml.principal_components(table(spark, sf, "embeddings"), "embedding").select("vec_id", F.round(F.abs(F.col("pc")[0]), 4).alias("pc1"), F.round(F.abs(F.col("pc")[1]), 4).alias("pc2"))


@plan()
def m2_umap_layout(spark, sf):
    """A layout in two dimensions of all vectors, by 15 neighbours."""
    return manifold.umap(table(spark, sf, "embeddings"), "vec_id", "embedding")


@plan()
def m3_clusters(spark, sf):
    return ml.cluster(table(spark, sf, "embeddings"), "embedding", 10, least=5).select("vec_id", "cluster")


@plan()
def m3_density_clusters(spark, sf):
    """Density clusters of 20 points at least on the first two components, by their 5th neighbours."""
    two = ml.principal_components(table(spark, sf, "embeddings"), "embedding").select("vec_id", F.slice("pc", 1, 2).alias("x"))
    return density.cluster(two, "vec_id", "x", 20, 5)


@plan()
def m4_stability(spark, sf):
    return ml.stability(table(spark, sf, "embeddings"), "embedding", 8, least=5)


@plan()
def m5_subclusters(spark, sf):
    parent = table(spark, sf, "embeddings").where("label = 0")
    return ml.cluster(parent, "embedding", 3).select("vec_id", F.concat(F.lit("0_"), F.col("cluster").cast("string")).alias("subcluster_id"))


@plan()
def m7_classifier(spark, sf):
    c = ml.split(catalogue(spark, sf), "event_id").withColumn("truth", F.when(F.col("snr") > 50, "loud").otherwise("quiet")).withColumn("x", F.col("snr") / 100)
    return ml.classify(c.where("part = 'train'"), c.where("part <> 'train'"), ["x", "duration_s"], "truth").select("event_id", "truth", "predicted")


@plan("SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 70 THEN 'train' WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 85 THEN 'validation' ELSE 'test' END AS part FROM cat")
def m8_split(spark, sf):
    return ml.split(catalogue(spark, sf), "event_id").select("event_id", "part")


@plan(f"""{_ARR}, d AS (SELECT a.vec_id, a.label AS own, b.label AS other, b.vec_id AS o, sqrt(sum((CAST(a.v AS DOUBLE) - b.v) * (CAST(a.v AS DOUBLE) - b.v))) AS d FROM x a JOIN x b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
m AS (SELECT vec_id, own, other, avg(d) AS d FROM d GROUP BY ALL), g AS (SELECT vec_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM m GROUP BY vec_id) SELECT vec_id, round((b - a) / greatest(a, b), 4) AS silhouette FROM g""")
def a28_silhouette(spark, sf):
    return ml.silhouette(table(spark, sf, "embeddings"), "embedding", "label", "vec_id").select("vec_id", F.round("silhouette", 4).alias("silhouette"))
