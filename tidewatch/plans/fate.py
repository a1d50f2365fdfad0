"""Validation against an independent catalogue: coverage, matches and what became of each reference event."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import rel, scans, verdicts
from ..sources.tables import catalogue
from .registry import plan

S = 1_000_000

_WINDOWS = """r AS (SELECT min(onset_us) - 1800000000 AS lo, max(end_us) + 1800000000 AS hi FROM cat WHERE event_type <> 'error' GROUP BY mooring, file_number),
t AS (SELECT *, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r), g AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM t),
w AS (SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY run), ref AS (SELECT event_id AS ref_id, onset_us AS ref_us FROM cat WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM w WHERE onset_us BETWEEN w.lo AND w.hi)),
p AS (SELECT ref_id, d.event_id, d.band, d.snr, d.duration_s, abs(d.onset_us - ref_us) AS adt, d.onset_us FROM ref JOIN cat d ON d.event_type <> 'error' AND d.onset_us BETWEEN ref_us - 30000000 AND ref_us + 30000000),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY adt, onset_us, event_id) = 1),
a AS (SELECT ref_id, bool_or(band = 'low' AND snr >= 6 AND duration_s <= 60) AS accepted FROM p GROUP BY ref_id),
f AS (SELECT ref.ref_id, CASE WHEN a.accepted THEN 'accepted' WHEN n.ref_id IS NULL THEN 'no_detection' WHEN n.band <> 'low' THEN 'not_in_lowband' WHEN n.duration_s > 60 THEN 'whale' WHEN n.snr < 6 THEN 'low_snr' ELSE 'other' END AS fate FROM ref LEFT JOIN a USING (ref_id) LEFT JOIN n USING (ref_id))"""


def coverage(c, pad_us: int):
    """Padded recording windows of all stations and files, merged. Windows are few next to events: one for each file."""
    w = c.groupBy("mooring", "file_number").agg((F.min("onset_us") - pad_us).alias("lo"), (F.max("end_us") + pad_us).alias("hi"))
    return scans.merge_intervals(w.select("lo", "hi"), "lo", "hi").select("lo", "hi")


def covered(points, windows, t: str):
    """Points in any of the disjoint windows: windows go to each day that they touch."""
    day = 86_400 * S
    w = windows.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / day), F.floor(F.col("hi") / day))).alias("_day")).alias("w")
    p = points.withColumn("_day", F.floor(F.col(t) / day)).alias("p")
    return p.join(w, (F.col("p._day") == F.col("w._day")) & F.col(t).between(F.col("lo"), F.col("hi")), "left_semi").drop("_day")


def _fates(spark, sf):
    c = catalogue(spark, sf)
    det = c.where("event_type <> 'error'")
    ref = covered(c.where("event_type = 'error'").select(F.col("event_id").alias("ref_id"), F.col("onset_us").alias("ref_us")), coverage(det, 1800 * S), "ref_us")
    pairs = rel.range_join(ref, det.select("event_id", "onset_us", "band", "snr", "duration_s"), "ref_us", "onset_us", 30 * S)
    ok = (F.col("band") == "low") & (F.col("snr") >= 6) & (F.col("duration_s") <= 60)
    near = F.min(F.struct(F.abs(F.col("onset_us") - F.col("ref_us")), "onset_us", "event_id", "band", "snr", "duration_s")).alias("n")
    m = pairs.groupBy("ref_id").agg(F.bool_or(ok).alias("accepted"), near)
    fate = F.when(F.col("accepted"), "accepted").when(F.col("n").isNull(), "no_detection").when(F.col("n.band") != "low", "not_in_lowband").when(F.col("n.duration_s") > 60, "whale").when(F.col("n.snr") < 6, "low_snr").otherwise("other")
    return ref.join(m, "ref_id", "left").select("ref_id", fate.alias("fate"))


@plan(f"{_WINDOWS} SELECT ref_id, fate FROM f")
def g26_fate_cascade(spark, sf):
    return _fates(spark, sf)


@plan(f"{_WINDOWS} SELECT fate, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f GROUP BY fate")
def fate_summary(spark, sf):
    """The flagship: coverage windows, matches in time, what became of each reference event, counts."""
    g = _fates(spark, sf).groupBy("fate").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


_LEVELS = {"located": ("snr > 150", 30), "classified": ("snr > 80", 30), "detected": ("true", 30), "near_activity": ("true", 300)}


@plan("ref AS (SELECT event_id AS ref_id, onset_us AS ref_us FROM cat WHERE event_type = 'error'), det AS (SELECT * FROM cat WHERE event_type <> 'error') SELECT ref_id, CASE " + " ".join(f"WHEN EXISTS (SELECT 1 FROM det WHERE {w} AND onset_us BETWEEN ref_us - {t * S} AND ref_us + {t * S}) THEN '{k}'" for k, (w, t) in _LEVELS.items()) + " ELSE 'none' END AS level FROM ref")
def g27_fate_by_level(spark, sf):
    """The first level with a match in its tolerance; one range join at the widest serves them all."""
    c = catalogue(spark, sf)
    ref = c.where("event_type = 'error'").select(F.col("event_id").alias("ref_id"), F.col("onset_us").alias("ref_us"))
    pairs = rel.range_join(ref, c.where("event_type <> 'error'").select("onset_us", "snr"), "ref_us", "onset_us", 300 * S)
    rank = F.when(F.lit(False), 0)
    for i, (where, tol) in enumerate(_LEVELS.values()):
        rank = rank.when(F.expr(where) & (F.abs(F.col("onset_us") - F.col("ref_us")) <= tol * S), i)
    best = pairs.groupBy("ref_id").agg(F.min(rank).alias("k"))
    names = F.array(*[F.lit(x) for x in (*_LEVELS, "none")])
    return ref.join(best, "ref_id", "left").select("ref_id", F.element_at(names, F.coalesce("k", F.lit(len(_LEVELS))).cast("int") + 1).alias("level"))


@plan("""SELECT event_id, CASE WHEN band = 'low' THEN 'seismic' ELSE 'cryogenic' END AS phase3_class, band FROM cat WHERE band = 'low' AND mooring IN ('m1', 'm2', 'm3') OR band = 'high' AND mooring IN ('m4', 'm5') AND snr >= 6""")
def g25_assembly(spark, sf):
    """Accepted clusters of each band, with a floor on one, as one catalogue."""
    c = catalogue(spark, sf)
    low = c.where((F.col("band") == "low") & F.col("mooring").isin("m1", "m2", "m3")).withColumn("phase3_class", F.lit("seismic"))
    high = c.where((F.col("band") == "high") & F.col("mooring").isin("m4", "m5") & (F.col("snr") >= 6)).withColumn("phase3_class", F.lit("cryogenic"))
    return low.unionByName(high).select("event_id", "phase3_class", "band")


@plan("""q AS (SELECT band, quantile_cont(snr, 0.1) AS s1, quantile_cont(snr, 0.9) AS s9, quantile_cont(duration_s, 0.1) AS d1, quantile_cont(duration_s, 0.9) AS d9 FROM cat WHERE mooring IN ('m1', 'm2') GROUP BY band)
SELECT event_id, (snr < s1 OR snr > s9)::INT + (duration_s < d1 OR duration_s > d9)::INT AS outside FROM cat JOIN q USING (band) WHERE (snr < s1 OR snr > s9)::INT + (duration_s < d1 OR duration_s > d9)::INT >= 2""")
def g29_reference_profile(spark, sf):
    """Events with two features or more outside the tenth to ninetieth percentile of the reviewed ones of their label."""
    c = catalogue(spark, sf)
    p = lambda x, q: F.percentile(x, q)
    q = c.where(F.col("mooring").isin("m1", "m2")).groupBy("band").agg(p("snr", 0.1).alias("s1"), p("snr", 0.9).alias("s9"), p("duration_s", 0.1).alias("d1"), p("duration_s", 0.9).alias("d9"))
    out = (~F.col("snr").between(F.col("s1"), F.col("s9"))).cast("int") + (~F.col("duration_s").between(F.col("d1"), F.col("d9"))).cast("int")
    return c.join(F.broadcast(q), "band").withColumn("outside", out).where("outside >= 2").select("event_id", "outside")


@plan("t AS (SELECT event_id, mooring, snr, duration_s, event_id % 5 + 2 AS n FROM cat) SELECT event_id, CAST(n AS BIGINT) AS n_moorings, CASE WHEN n = 2 THEN 'D' WHEN snr < 40 THEN 'A' ELSE 'B' END AS tier, CASE WHEN n > 2 THEN duration_s END AS lat FROM t")
def g14_two_station_rows(spark, sf):
    """Associations of two stations join the located ones as tier D without a position."""
    t = catalogue(spark, sf).withColumn("n_moorings", (F.col("event_id") % 5 + 2).cast("long"))
    located = t.where("n_moorings > 2").select("event_id", "n_moorings", F.when(F.col("snr") < 40, "A").otherwise("B").alias("tier"), F.col("duration_s").alias("lat"))
    return located.unionByName(t.where("n_moorings = 2").select("event_id", "n_moorings", F.lit("D").alias("tier")), allowMissingColumns=True)


@plan("SELECT event_id, snr < 40 AND duration_s > 30 AND NOT coalesce(CASE WHEN event_id % 4 <> 0 THEN snr / 100 END >= 0.15, false) AS icequake_filtered FROM cat WHERE band = 'high'")
def g16_ice_rule(spark, sf):
    """An icequake far from the coast needs ice; an unknown concentration is no ice."""
    c = catalogue(spark, sf).where("band = 'high'")
    conc = F.when(F.col("event_id") % 4 != 0, F.col("snr") / 100)
    return c.select("event_id", ((F.col("snr") < 40) & (F.col("duration_s") > 30) & ~F.coalesce(conc >= 0.15, F.lit(False))).alias("icequake_filtered"))


@plan("""g AS (SELECT *, CASE WHEN onset_us - lag(onset_us) OVER (PARTITION BY mooring ORDER BY onset_us, event_id) > 3600000000 THEN 1 ELSE 0 END AS brk FROM cat),
s AS (SELECT *, sum(brk) OVER (PARTITION BY mooring ORDER BY onset_us, event_id ROWS UNBOUNDED PRECEDING) AS swarm FROM g), k AS (SELECT mooring, swarm, median(snr) AS mx, median(duration_s) AS my FROM s GROUP BY ALL HAVING count(*) >= 10),
d AS (SELECT s.event_id, s.mooring, s.swarm, sqrt((snr - mx) * (snr - mx) + (duration_s - my) * (duration_s - my)) AS dist FROM s JOIN k USING (mooring, swarm)), m AS (SELECT mooring, swarm, median(dist) AS md FROM d GROUP BY ALL),
a AS (SELECT mooring, swarm, any_value(md) AS md, greatest(median(abs(dist - md)), 1.0) AS mad FROM d JOIN m USING (mooring, swarm) GROUP BY ALL)
SELECT event_id, swarm, round(dist, 6) AS dist, dist > md + 3 * mad AS outlier FROM d JOIN a USING (mooring, swarm)""")
def g17_swarm_coherence(spark, sf):
    """Sessions of ten events or more: distance to the medians, and outliers by the median absolute deviation. Numbers are given before small sessions go."""
    s = scans.islands(catalogue(spark, sf), ["mooring"], ["onset_us", "event_id"], F.col("onset_us") - F.col("prev.onset_us") > 3600 * S, "swarm")
    key = ["mooring", "swarm"]
    k = s.groupBy(*key).agg(F.median("snr").alias("mx"), F.median("duration_s").alias("my"), F.count("*").alias("n")).where("n >= 10")
    d = s.join(k, key).withColumn("dist", F.expr("sqrt((snr - mx) * (snr - mx) + (duration_s - my) * (duration_s - my))"))
    d = d.join(d.groupBy(*key).agg(F.median("dist").alias("md")), key)
    a = d.groupBy(*key).agg(F.greatest(F.median(F.abs(F.col("dist") - F.col("md"))), F.lit(1.0)).alias("mad"))
    return d.join(a, key).select("event_id", "swarm", F.round("dist", 6).alias("dist"), (F.col("dist") > F.col("md") + 3 * F.col("mad")).alias("outlier"))


@plan("SELECT event_id, round(15 * log10(greatest(sqrt(((duration_s - 50) * 111) * ((duration_s - 50) * 111) + ((snr / 100) * 111 * cos(radians(62.5))) * ((snr / 100) * 111 * cos(radians(62.5)))), 100)) + snr, 5) AS level FROM cat")
def g24_source_level(spark, sf):
    from ..functions import text

    km = F.sqrt(F.pow((F.col("duration_s") - 50) * 111, F.lit(2)) + F.pow(F.col("snr") / 100 * 111 * F.cos(F.radians(F.lit(62.5))), F.lit(2)))
    return catalogue(spark, sf).select("event_id", F.round(text.source_level(F.col("snr"), km), 5).alias("level"))


@plan("SELECT file_number, CASE min(CASE band WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END) WHEN 0 THEN 'tphase' WHEN 1 THEN 'icequake' ELSE 'vessel' END AS event_class FROM cat GROUP BY file_number")
def g15_association_class(spark, sf):
    c = catalogue(spark, sf).withColumn("label", rules.recode(F.col("band"), {"low": "tphase", "mid": "icequake", "high": "vessel"}))
    return c.groupBy("file_number").agg(rules.first_class(F.col("label")).alias("event_class"))


@plan("""p AS (SELECT l_orderkey AS k, l_suppkey AS s, min(l_quantity) FILTER (l_returnflag = 'A') AS tp, min(l_quantity) FILTER (l_returnflag = 'R') AS ts FROM lineitem GROUP BY ALL)
SELECT k, s, round((ts - tp) * 6.5 * 3.75 / (6.5 - 3.75), 6) AS km FROM p WHERE tp IS NOT NULL AND ts IS NOT NULL AND ts > tp""")
def g23_s_minus_p(spark, sf):
    """Distance from the delay between the phases of one station."""
    from ..sources.tables import table

    first = lambda f: F.min(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).agg(first("A").alias("tp"), first("R").alias("ts")).where("ts > tp")
    return p.select("k", "s", F.round((F.col("ts") - F.col("tp")) * 6.5 * 3.75 / (6.5 - 3.75), 6).alias("km"))


@plan()
def g28_verdict_events(spark, sf):
    """Verdicts on the panels of each band's two samples, with the events that they are on."""
    c = catalogue(spark, sf).select("event_id", F.col("band").alias("cluster_id"), F.col("snr").alias("x"), F.col("duration_s").alias("y"))
    kinds, panels = F.explode(F.array(*[F.lit(k) for k in verdicts.SEEDS])), F.explode(F.sequence(F.lit(1), F.lit(verdicts.SAMPLE)))
    v = c.select("cluster_id").distinct().withColumn("sample", kinds).withColumn("panel", panels).withColumn("verdict", F.when(F.col("panel") % 4 == 0, "r").otherwise("a"))
    return verdicts.judged(c, v, width=1 << 16)
