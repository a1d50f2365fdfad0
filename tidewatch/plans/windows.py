"""Ordered-row operators on the catalogue: gaps, sessions, bouts, interval merges, triggers, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scans
from ..sources.tables import catalogue
from .registry import plan

_W = "PARTITION BY mooring ORDER BY onset_us, event_id"
_ORDER = ["onset_us", "event_id"]


@plan(f"SELECT event_id, onset_us - lag(onset_us) OVER ({_W}) AS dt_us FROM cat")
def w1_lag_difference(spark, sf):
    c = scans.Scan(catalogue(spark, sf), ["mooring"], _ORDER).previous("prev", "onset_us").rows()
    return c.select("event_id", (F.col("onset_us") - F.col("prev.onset_us")).alias("dt_us"))


@plan(f"""g AS (SELECT *, CASE WHEN onset_us - lag(onset_us) OVER ({_W}) > 3600000000 THEN 1 ELSE 0 END AS brk FROM cat)
SELECT event_id, sum(brk) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS session FROM g""")
def w2_gap_sessions(spark, sf):
    return scans.islands(catalogue(spark, sf), ["mooring"], _ORDER, F.col("onset_us") - F.col("prev.onset_us") > 3_600_000_000, "session").select("event_id", "session")


@plan(f"""d AS (SELECT *, (onset_us - lag(onset_us) OVER ({_W})) / 1e6 AS gap FROM cat), f AS (SELECT *, CASE WHEN gap BETWEEN 120 AND 1800 THEN 0 ELSE 1 END AS brk FROM d),
r AS (SELECT *, sum(brk) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT mooring, min(onset_us) AS begin_us, max(onset_us) AS end_us, count(*) AS n FROM r GROUP BY mooring, run HAVING count(*) >= 3""")
def w3_bouts(spark, sf):
    """Runs of at least three events whose gaps are all in a range; the event before the first gap belongs to the run."""
    gap = (F.col("onset_us") - F.col("prev.onset_us")) / 1e6
    r = scans.islands(catalogue(spark, sf), ["mooring"], _ORDER, ~gap.between(120, 1800), "run")
    return r.groupBy("mooring", "run").agg(F.min("onset_us").alias("begin_us"), F.max("onset_us").alias("end_us"), F.count("*").alias("n")).where("n >= 3").drop("run")


_MERGE = """w AS (SELECT {p} onset_us AS lo, end_us AS hi FROM cat), t AS (SELECT *, max(hi) OVER ({q} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM w),
r AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER ({q} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT {p} min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM r GROUP BY {p} run"""


@plan(_MERGE.format(p="file_number,", q="PARTITION BY file_number"))
def w4_merge_intervals(spark, sf):
    w = catalogue(spark, sf).select("file_number", F.col("onset_us").alias("lo"), F.col("end_us").alias("hi"))
    return scans.merge_intervals(w, "lo", "hi", ["file_number"])


@plan(_MERGE.format(p="mooring,", q="PARTITION BY mooring"))
def w5_merge_intervals_by_station(spark, sf):
    w = catalogue(spark, sf).select("mooring", F.col("onset_us").alias("lo"), F.col("end_us").alias("hi"))
    return scans.merge_intervals(w, "lo", "hi", ["mooring"])


_TRIG = f"""v AS (SELECT mooring, snr, row_number() OVER ({_W}) - 1 AS i FROM cat), s AS (SELECT *, coalesce(last_value(CASE WHEN snr >= 60 THEN 1 WHEN snr <= 30 THEN 0 END IGNORE NULLS) OVER (PARTITION BY mooring ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS st FROM v),
e AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY mooring ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS up, CASE WHEN st = 0 AND lag(st) OVER (PARTITION BY mooring ORDER BY i) = 1 THEN i END AS dn FROM s),
r AS (SELECT *, sum(up) OVER (PARTITION BY mooring ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e), trig AS (SELECT mooring, min(i) AS on_at, coalesce(min(dn), max(i)) AS off_at FROM r WHERE run > 0 GROUP BY mooring, run)"""


def _triggers(spark, sf):
    return scans.triggers(catalogue(spark, sf).select("mooring", "snr", *_ORDER), ["mooring"], _ORDER, "snr", 60, 30)


@plan(f"{_TRIG} SELECT mooring, on_at, off_at FROM trig")
def w6_hysteresis_trigger(spark, sf):
    return _triggers(spark, sf)


@plan(f"""{_TRIG}, k AS (SELECT *, on_at - lag(off_at) OVER (PARTITION BY mooring ORDER BY on_at) AS gap FROM trig WHERE off_at - on_at >= 2),
m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY mooring ORDER BY on_at ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT mooring, min(on_at) AS on_at, max(off_at) AS off_at FROM m GROUP BY mooring, run""")
def w7_min_duration_then_gap_merge(spark, sf):
    """Short triggers go first, so that they cannot bridge two events; then those with a short gap are merged."""
    t = _triggers(spark, sf).where("off_at - on_at >= 2")
    return scans.islands(t, ["mooring"], ["on_at", "off_at"], F.col("on_at") - F.col("prev.off_at") >= 3, "run", 4096).groupBy("mooring", "run").agg(F.min("on_at").alias("on_at"), F.max("off_at").alias("off_at")).drop("run")


@plan("""t AS (SELECT *, max(end_us) OVER (PARTITION BY mooring ORDER BY onset_us, end_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM cat),
r AS (SELECT *, sum(CASE WHEN top IS NULL OR onset_us > top THEN 1 ELSE 0 END) OVER (PARTITION BY mooring ORDER BY onset_us, end_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT mooring, arg_max(event_id, struct_pack(a := snr, b := event_id)) AS best, count(DISTINCT band) AS bands, count(*) AS n FROM r GROUP BY mooring, run""")
def w8_cross_band_merge(spark, sf):
    s = scans.Scan(catalogue(spark, sf), ["mooring"], ["onset_us", "end_us", "event_id"]).running("end_us", "max", "top", before=True)
    r = s.running(F.coalesce(F.col("onset_us") > F.col("top"), F.lit(False)).cast("long"), "sum", "run").rows()
    return r.groupBy("mooring", "run").agg(F.max_by("event_id", F.struct("snr", "event_id")).alias("best"), F.count_distinct("band").alias("bands"), F.count("*").alias("n")).drop("run")


@plan(f"""v AS (SELECT event_id, mooring, snr, row_number() OVER ({_W}) - 1 AS i, avg(snr) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sta, avg(snr) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS lta FROM cat)
SELECT event_id, round(CASE WHEN i < 30 OR lta <= 0 THEN 0 ELSE sta / lta END, 6) AS ratio FROM v""")
def w9_sta_lta(spark, sf):
    """Ratio of trailing means; 0 before both windows have filled, an index late, and where the long mean is not positive."""
    w = scans.frame(["mooring"])
    c = scans.framed(catalogue(spark, sf), ["mooring"], _ORDER, 29, 0)
    v = c.select("event_id", "_own", F.col("_i").alias("i"), F.avg("snr").over(w.rowsBetween(-4, 0)).alias("sta"), F.avg("snr").over(w.rowsBetween(-29, 0)).alias("lta"))
    return v.where("_own").select("event_id", F.round(F.when((F.col("i") < 30) | (F.col("lta") <= 0), 0.0).otherwise(F.col("sta") / F.col("lta")), 6).alias("ratio"))


@plan(f"""v AS (SELECT event_id, list(snr) OVER ({_W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v FROM cat), m AS (SELECT *, list_avg(v) AS m FROM v WHERE len(v) = 50), d AS (SELECT event_id, list_transform(v, lambda x: x - m) AS d FROM m)
SELECT event_id, round(list_avg(list_transform(d, lambda x: x * x * x * x)) / pow(list_avg(list_transform(d, lambda x: x * x)), 2) - 3, 3) + 0e0 AS kurtosis FROM d""")
def w10_sliding_kurtosis(spark, sf):
    """Excess kurtosis of the last 50 rows, from sums of powers of the values less their station's mean, so that the sums don't cancel."""
    means = catalogue(spark, sf).groupBy("mooring").agg(F.avg("snr").alias("c"))
    d = scans.framed(catalogue(spark, sf), ["mooring"], _ORDER, 49, 0).join(F.broadcast(means), "mooring").withColumn("d", F.col("snr") - F.col("c"))
    w = scans.frame(["mooring"]).rowsBetween(-49, 0)
    # sums of frames that slide are made anew for each row, so that no error is carried along
    s = d.select("event_id", "_own", F.count("d").over(w).alias("n"), *[(F.sum(F.pow("d", F.lit(k))).over(w) / 50).alias(f"m{k}") for k in (1, 2, 3, 4)]).where("_own AND n = 50")
    m, m2, m3, m4 = (F.col(f"m{k}") for k in (1, 2, 3, 4))
    var = m2 - m * m
    return s.select("event_id", F.round((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / (var * var) - 3, 3).alias("kurtosis"))


@plan(f"s AS (SELECT event_id, mooring, onset_us, avg(snr) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM cat) SELECT event_id, round(s, 6) AS smooth, round((lead(s) OVER ({_W}) - lag(s) OVER ({_W})) / 2, 6) AS gradient FROM s")
def w11_boxcar_and_gradient(spark, sf):
    w = scans.frame(["mooring"])
    s = scans.framed(catalogue(spark, sf), ["mooring"], _ORDER, 3, 3).withColumn("s", F.avg("snr").over(w.rowsBetween(-2, 2)))
    return s.select("event_id", "_own", F.round("s", 6).alias("smooth"), F.round((F.lead("s").over(w) - F.lag("s").over(w)) / 2, 6).alias("gradient")).where("_own").drop("_own")


@plan(f"r AS (SELECT event_id, median(snr) OVER w AS med, count(*) OVER w AS n FROM cat WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT event_id, round(CASE WHEN n >= 8 THEN med END, 6) AS med FROM r")
def w12_rolling_median(spark, sf):
    w = scans.frame(["mooring"]).rowsBetween(-5, 5)
    # a window's median is that of its few values: taken from the sorted list
    r = scans.framed(catalogue(spark, sf), ["mooring"], _ORDER, 5, 5).select("event_id", "_own", F.sort_array(F.collect_list("snr").over(w)).alias("v")).where("_own")
    n = F.size("v")
    med = (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.floor((n + 2) / 2).cast("int"))) / 2
    return r.select("event_id", F.round(F.when(n >= 8, med), 6).alias("med"))


@plan(f"SELECT event_id, lag(end_us) OVER ({_W}) AS prev_end, greatest(onset_us - 5000000, coalesce(lag(end_us) OVER ({_W}), onset_us - 5000000)) AS search_from FROM cat")
def w13_previous_end(spark, sf):
    c = scans.Scan(catalogue(spark, sf), ["mooring"], _ORDER).previous("prev", "end_us").rows()
    prev = F.col("prev.end_us")
    return c.select("event_id", prev.alias("prev_end"), F.greatest(F.col("onset_us") - 5_000_000, F.coalesce(prev, F.col("onset_us") - 5_000_000)).alias("search_from"))


@plan("SELECT event_id, printf('E%06d', CAST(row_number() OVER (ORDER BY onset_us, mooring, band, event_id) - 1 AS INT)) AS id FROM cat")
def w14_sequential_ids(spark, sf):
    """Numbers in a global order without a global sort in one task: ranks within a day, after the counts of the days before."""
    c = catalogue(spark, sf).withColumn("day", F.floor(F.col("file_number") / 6))
    sizes = c.groupBy("day").agg(F.count("*").alias("n"))
    begin = sizes.select("day", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    k = F.row_number().over(Window.partitionBy("day").orderBy("onset_us", "mooring", "band", "event_id")) - 1
    ranked = c.select("event_id", "day", k.alias("k")).join(begin, "day")
    return ranked.select("event_id", F.format_string("E%06d", F.col("begin") + F.col("k")).alias("id"))


@plan("b AS (SELECT CAST(floor(snr / 10) AS BIGINT) AS bin, count(*) AS n FROM cat GROUP BY bin) SELECT bin, sum(n) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS at_least FROM b")
def w15_reverse_cumulative_count(spark, sf):
    b = catalogue(spark, sf).groupBy(F.floor(F.col("snr") / 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return b.select("bin", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)).alias("at_least"))


@plan("""q AS (SELECT band, quantile_cont(duration_s, [0.2, 0.4, 0.6, 0.8]) AS e FROM cat GROUP BY band)
SELECT event_id, CAST((duration_s > e[1])::INT + (duration_s > e[2])::INT + (duration_s > e[3])::INT + (duration_s > e[4])::INT AS BIGINT) AS bin FROM cat JOIN q USING (band)""")
def w16_quantile_bins(spark, sf):
    """Bins by interpolated edges, closed on the right; equal values stay together, as ntile would not keep them."""
    c = catalogue(spark, sf)
    q = c.groupBy("band").agg(F.percentile("duration_s", F.array(*[F.lit(p) for p in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    return c.join(F.broadcast(q), "band").select("event_id", F.size(F.filter("e", lambda x: F.col("duration_s") > x)).cast("long").alias("bin"))


@plan("""n AS (SELECT a.event_id, b.onset_us, b.event_id AS o FROM cat a JOIN cat b ON a.mooring = b.mooring AND b.onset_us BETWEEN a.onset_us - 1800000000 AND a.onset_us + 1800000000),
d AS (SELECT event_id, (onset_us - lag(onset_us) OVER (PARTITION BY event_id ORDER BY onset_us, o)) / 1e6 AS gap FROM n) SELECT event_id, count(*) FILTER (abs(gap - 600) <= 200) AS n_near FROM d GROUP BY event_id""")
def w17_intervals_near_target(spark, sf):
    """How many intervals between neighbours within half an hour are near ten minutes."""
    half = 1_800_000_000
    c = catalogue(spark, sf).where("mooring IS NOT NULL AND onset_us IS NOT NULL").select("event_id", "onset_us", "mooring")
    gaps = scans.Scan(c, ["mooring"], _ORDER).previous("prev", "onset_us").rows().withColumn("prev", F.col("prev.onset_us"))
    near = gaps.where(F.abs((F.col("onset_us") - F.col("prev")) / 1e6 - 600) <= 200)
    # an interval is in the window of the events from half an hour before its end to half an hour after its beginning: it opens before these and closes after them
    none = F.lit(None).cast("long").alias("event_id")
    marks = c.select("mooring", F.col("onset_us").alias("t"), F.lit(1).alias("kind"), "event_id", F.lit(0).cast("long").alias("d"))
    marks = marks.unionByName(near.select("mooring", (F.col("onset_us") - half).alias("t"), F.lit(0).alias("kind"), none, F.lit(1).cast("long").alias("d")))
    marks = marks.unionByName(near.select("mooring", (F.col("prev") + half).alias("t"), F.lit(2).alias("kind"), none, F.lit(-1).cast("long").alias("d")))
    return scans.Scan(marks, ["mooring"], ["t", "kind"]).running("d", "sum", "n_near").rows().where("kind = 1").select("event_id", "n_near")
