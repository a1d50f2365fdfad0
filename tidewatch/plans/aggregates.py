"""Aggregations on the catalogue and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import rel
from ..sources.tables import catalogue, table
from .registry import plan


@plan("SELECT mooring, band, count(*) AS n FROM cat GROUP BY ALL")
def a1_counts(spark, sf):
    return catalogue(spark, sf).groupBy("mooring", "band").agg(F.count("*").alias("n"))


@plan("SELECT file_number // 6 AS day, count(*) FILTER (band = 'low') AS low, count(*) FILTER (band = 'mid') AS mid, count(*) FILTER (band = 'high') AS high FROM cat GROUP BY day")
def a2_pivot_zero_filled(spark, sf):
    return catalogue(spark, sf).groupBy(F.floor(F.col("file_number") / 6).alias("day")).pivot("band", ["low", "mid", "high"]).count().na.fill(0)


@plan("""SELECT coalesce(mooring, 'All') AS mooring, count(*) FILTER (band = 'low') AS low, count(*) FILTER (band = 'mid') AS mid, count(*) FILTER (band = 'high') AS high, count(*) AS "All" FROM cat GROUP BY ROLLUP (mooring)""")
def a3_crosstab_with_margins(spark, sf):
    return rel.crosstab(catalogue(spark, sf), "mooring", "band", ["low", "mid", "high"])


@plan("SELECT mooring, file_number, min(onset_us) - 30000000 AS lo, max(end_us) + 30000000 AS hi FROM cat GROUP BY ALL")
def a4_recording_windows(spark, sf):
    return catalogue(spark, sf).groupBy("mooring", "file_number").agg((F.min("onset_us") - 30_000_000).alias("lo"), (F.max("end_us") + 30_000_000).alias("hi"))


@plan("SELECT band, round(median(snr), 6) AS med, round(quantile_cont(snr, 0.25), 6) AS q1, round(quantile_cont(snr, 0.75), 6) AS q3, round(quantile_cont(snr, 0.75) - quantile_cont(snr, 0.25), 6) AS iqr FROM cat GROUP BY band")
def a5_quartiles(spark, sf):
    q = catalogue(spark, sf).groupBy("band").agg(F.median("snr").alias("med"), F.percentile("snr", 0.25).alias("q1"), F.percentile("snr", 0.75).alias("q3"))
    return q.select("band", *[F.round(c, 6).alias(c) for c in ("med", "q1", "q3")], F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))


@plan("SELECT l_orderkey, count(DISTINCT l_suppkey) AS stations, count(DISTINCT l_suppkey || l_returnflag) AS station_phases FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) >= 3 AND count(DISTINCT l_suppkey || l_returnflag) >= 4")
def a6_distinct_counts(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("stations"), F.count_distinct(F.concat(F.col("l_suppkey").cast("string"), "l_returnflag")).alias("station_phases"))
    return p.where("stations >= 3 AND station_phases >= 4")


@plan("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_p, count(*) FILTER (l_returnflag = 'R') AS n_s, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS stations_p,
coalesce(max(l_discount) FILTER (l_returnflag = 'A'), 0) AS max_p, coalesce(max(l_discount) FILTER (l_returnflag = 'R'), 0) AS max_s FROM lineitem GROUP BY l_orderkey""")
def a7_conditional_aggregates(spark, sf):
    p, s = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(p).alias("n_p"), F.count_if(s).alias("n_s"), F.count_distinct(F.when(p, F.col("l_suppkey"))).alias("stations_p"), F.coalesce(F.max(F.when(p, F.col("l_discount"))), F.lit(0.0)).alias("max_p"), F.coalesce(F.max(F.when(s, F.col("l_discount"))), F.lit(0.0)).alias("max_s"))


@plan("SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def a8_has_both_phases(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("p"), F.bool_or(F.col("l_returnflag") == "R").alias("s"))
    return g.where("p AND s").select("l_orderkey", "l_suppkey")


@plan("SELECT file_number, mooring, event_id FROM cat QUALIFY row_number() OVER (PARTITION BY file_number, mooring ORDER BY snr DESC, onset_us, event_id) = 1")
def a9_best_per_station(spark, sf):
    best = F.min_by("event_id", F.struct(-F.col("snr"), "onset_us", "event_id"))
    return catalogue(spark, sf).groupBy("file_number", "mooring").agg(best.alias("event_id"))


@plan("SELECT l_orderkey, l_returnflag, l_linenumber, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) = 1")
def a10_best_row_per_key(spark, sf):
    return rel.first_per(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], F.col("l_discount").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).select("l_orderkey", "l_returnflag", "l_linenumber", "l_discount")


@plan("SELECT mooring, file_number, arg_max(event_id, event_id) AS event_id, count(*) AS n FROM cat GROUP BY ALL")
def a11_keep_last(spark, sf):
    return catalogue(spark, sf).groupBy("mooring", "file_number").agg(F.max_by("event_id", "event_id").alias("event_id"), F.count("*").alias("n"))


@plan("k AS (SELECT file_number, event_type, count(*) AS n FROM cat GROUP BY ALL) SELECT file_number, event_type, n FROM k QUALIFY row_number() OVER (PARTITION BY file_number ORDER BY n DESC, event_type) = 1")
def a12_majority_class(spark, sf):
    k = catalogue(spark, sf).groupBy("file_number", "event_type").agg(F.count("*").alias("n"))
    return k.groupBy("file_number").agg(F.min(F.struct(-F.col("n"), "event_type")).alias("x"), F.max("n").alias("n")).select("file_number", F.col("x.event_type").alias("event_type"), "n")


@plan("SELECT file_number, CASE min(CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 END) WHEN 0 THEN 'purchase' WHEN 1 THEN 'signup' WHEN 2 THEN 'error' END AS class FROM cat GROUP BY file_number")
def a13_priority_class(spark, sf):
    return catalogue(spark, sf).groupBy("file_number").agg(rules.first_class(F.col("event_type"), ("purchase", "signup", "error")).alias("class"))


@plan("SELECT mooring, file_number, max(snr) AS snr, max(duration_s) AS duration_s, arg_max(event_id, struct_pack(a := snr, b := event_id)) AS loudest FROM cat GROUP BY ALL")
def a14_group_maxima(spark, sf):
    return catalogue(spark, sf).groupBy("mooring", "file_number").agg(F.max("snr").alias("snr"), F.max("duration_s").alias("duration_s"), F.max_by("event_id", F.struct("snr", "event_id")).alias("loudest"))


@plan("SELECT mooring, round(avg((snr <= 5)::INT), 6) AS le5, round(avg((snr <= 10)::INT), 6) AS le10, round(avg((snr <= 20)::INT), 6) AS le20, round(avg((snr <= 50)::INT), 6) AS le50, round(count(*) / (SELECT count(*) FROM cat), 6) AS share FROM cat GROUP BY mooring")
def a15_shares(spark, sf):
    c = catalogue(spark, sf)
    g = c.groupBy("mooring").agg(*[F.round(F.avg((F.col("snr") <= k).cast("int")), 6).alias(f"le{k}") for k in (5, 10, 20, 50)], F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6)).drop("n")


@plan("SELECT band, round(avg(snr), 6) AS mean, round(stddev_samp(snr), 6) AS sd1, round(stddev_pop(snr), 6) AS sd0 FROM cat GROUP BY band")
def a16_mean_and_deviations(spark, sf):
    return catalogue(spark, sf).groupBy("band").agg(F.round(F.avg("snr"), 6).alias("mean"), F.round(F.stddev_samp("snr"), 6).alias("sd1"), F.round(F.stddev_pop("snr"), 6).alias("sd0"))


@plan("m AS (SELECT mooring, median(snr) AS med FROM cat GROUP BY mooring) SELECT mooring, round(greatest(median(abs(snr - med)), 1.0), 6) AS mad FROM cat JOIN m USING (mooring) GROUP BY mooring")
def a17_median_absolute_deviation(spark, sf):
    c = catalogue(spark, sf)
    m = c.groupBy("mooring").agg(F.median("snr").alias("med"))
    return c.join(F.broadcast(m), "mooring").groupBy("mooring").agg(F.round(F.greatest(F.median(F.abs(F.col("snr") - F.col("med"))), F.lit(1.0)), 6).alias("mad"))


@plan("SELECT CAST(least(floor(snr / 25), 19) AS BIGINT) AS bin, count(*) AS n FROM cat WHERE snr BETWEEN 0 AND 500 GROUP BY bin")
def a18_histogram(spark, sf):
    """Bins of 25 from 0 to 500; the last is closed on the right."""
    return catalogue(spark, sf).where("snr BETWEEN 0 AND 500").groupBy(F.least(F.floor(F.col("snr") / 25), F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_MAG_SQL = "m AS (SELECT CAST(round(snr / 100 * 10) AS BIGINT) AS b FROM cat), h AS (SELECT b, count(*) AS n FROM m GROUP BY b), mc AS (SELECT b FROM h ORDER BY n DESC, b LIMIT 1), cum AS (SELECT h.b, sum(x.n) AS c FROM h JOIN h x ON x.b >= h.b GROUP BY h.b)"


@plan(f"{_MAG_SQL} SELECT (SELECT b FROM mc) AS mc, round(-regr_slope(log10(c), b / 10), 4) AS b_value, count(*) AS bins FROM cum WHERE b >= (SELECT b FROM mc)")
def a19_magnitude_slope(spark, sf):
    """Completeness by maximum curvature and the slope of the cumulative counts above it; bins are few whatever the input."""
    h = catalogue(spark, sf).groupBy(F.round(F.col("snr") / 100 * 10).cast("long").alias("b")).agg(F.count("*").alias("n"))
    cum = h.withColumn("c", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.withColumn("mc", F.min(F.struct(-F.col("n"), "b")).over(Window.partitionBy(F.lit(0)))["b"])
    return cum.where("b >= mc").agg(F.max("mc").alias("mc"), F.round(-F.regr_slope(F.log10("c"), F.col("b") / 10), 4).alias("b_value"), F.count("*").alias("bins"))


@plan("SELECT mooring, round(corr(snr, duration_s), 6) AS r FROM cat GROUP BY mooring")
def a20_pearson(spark, sf):
    return catalogue(spark, sf).groupBy("mooring").agg(F.round(F.corr("snr", "duration_s"), 6).alias("r"))


@plan("a AS (SELECT mooring, avg(sin(radians(snr))) AS s, avg(cos(radians(snr))) AS c FROM cat GROUP BY mooring) SELECT mooring, round(degrees(atan2(s, c)), 4) AS azimuth, round(sqrt(s * s + c * c), 6) AS length FROM a")
def a21_circular_mean(spark, sf):
    a = catalogue(spark, sf).groupBy("mooring").agg(F.avg(F.sin(F.radians("snr"))).alias("s"), F.avg(F.cos(F.radians("snr"))).alias("c"))
    return a.select("mooring", F.round(F.degrees(F.atan2("s", "c")), 4).alias("azimuth"), F.round(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")), 6).alias("length"))


_MONTHS = "months AS (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS month), o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice FROM orders WHERE extract(quarter FROM o_orderdate) <> 3)"


@plan(f"{_MONTHS} SELECT strftime(month, '%Y-%m') AS month, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM months LEFT JOIN o USING (month) GROUP BY month")
def a22_month_sums(spark, sf):
    """Months without orders are there, with 0."""
    o = table(spark, sf, "orders").where(F.quarter("o_orderdate") != 3).groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("t"))
    return rel.calendar(spark, "1994-01-01", "2002-12-01").join(o, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@plan(f"{_MONTHS} SELECT strftime(month, '%Y-%m') AS month, count(o_totalprice) AS n FROM months LEFT JOIN o USING (month) GROUP BY month")
def a23_full_month_range(spark, sf):
    o = table(spark, sf, "orders").where(F.quarter("o_orderdate") != 3).groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("k"))
    return rel.calendar(spark, "1994-01-01", "2002-12-01").join(o, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("k", F.lit(0)).alias("n"))


@plan("m AS (SELECT DISTINCT mooring FROM cat), b AS (SELECT DISTINCT band FROM cat) SELECT m.mooring, b.band, count(x.event_id) AS n, round(coalesce(avg(x.snr), 0), 6) AS mean FROM m CROSS JOIN b LEFT JOIN (SELECT * FROM cat WHERE snr > 330) x ON x.mooring = m.mooring AND x.band = b.band GROUP BY ALL")
def a24_dense_summary(spark, sf):
    """All pairs of six stations and three bands, empty ones as well."""
    c = catalogue(spark, sf)
    dims = c.select("mooring").distinct().withColumn("band", F.explode(F.array(*[F.lit(x) for x in ("low", "mid", "high")])))
    g = c.where("snr > 330").groupBy("mooring", "band").agg(F.count("*").alias("k"), F.avg("snr").alias("m"))
    return dims.join(g, ["mooring", "band"], "left").select("mooring", "band", F.coalesce("k", F.lit(0)).alias("n"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean"))


@plan("SELECT l_orderkey, round(sum(l_discount / ((l_quantity + 20) * (l_quantity + 20))) / sum(1 / ((l_quantity + 20) * (l_quantity + 20))), 6) AS mean FROM lineitem GROUP BY l_orderkey")
def a25_inverse_distance_mean(spark, sf):
    w = 1 / ((F.col("l_quantity") + 20) * (F.col("l_quantity") + 20))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_discount") * w) / F.sum(w), 6).alias("mean"))


@plan("SELECT l_orderkey, round(sum(l_quantity * l_discount) / sum(l_quantity) + 1e-9, 6) AS mean, round(sqrt(sum(l_quantity * l_discount * l_discount) / sum(l_quantity)) + 1e-9, 6) AS rms FROM lineitem GROUP BY l_orderkey")
def a26_weighted_mean_and_rms(spark, sf):
    w, x, tie = F.col("l_quantity"), F.col("l_discount"), 1e-9  # so that no quotient lies between two roundings
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(w * x) / F.sum(w) + tie, 6).alias("mean"), F.round(F.sqrt(F.sum(w * x * x) / F.sum(w)) + tie, 6).alias("rms"))


@plan("""prof AS (SELECT l_orderkey AS k, CAST(l_linenumber AS DOUBLE) * 50 AS z, 1450 + avg(l_quantity) AS c FROM lineitem WHERE l_linenumber * 50 <= 280 GROUP BY ALL),
seg AS (SELECT k, z, z - lag(z) OVER w AS dz, (1 / c + 1 / lag(c) OVER w) / 2 AS s FROM prof WINDOW w AS (PARTITION BY k ORDER BY z))
SELECT k, round(sum(dz) / sum(dz * s), 4) AS c_eff FROM seg WHERE dz IS NOT NULL GROUP BY k""")
def a27_harmonic_mean_speed(spark, sf):
    """Depth over travel time down to the last point within the limit, by the trapezoid rule on slowness."""
    prof = table(spark, sf, "lineitem").where("l_linenumber * 50 <= 280").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("double") * 50).alias("z")).agg((1450 + F.avg("l_quantity")).alias("c"))
    w = Window.partitionBy("k").orderBy("z")
    seg = prof.withColumn("dz", F.col("z") - F.lag("z").over(w)).withColumn("s", (1 / F.col("c") + 1 / F.lag("c").over(w)) / 2).where("dz IS NOT NULL")
    return seg.groupBy("k").agg(F.round(F.sum("dz") / F.sum(F.col("dz") * F.col("s")), 4).alias("c_eff"))


@plan("""p AS (SELECT CASE WHEN value > 50 THEN 'a' WHEN value > 20 THEN 'b' ELSE 'c' END AS pred, CASE WHEN user_id % 3 = 0 THEN 'a' WHEN user_id % 3 = 1 THEN 'b' ELSE 'c' END AS truth FROM events),
t AS (SELECT unnest(['a', 'b', 'c']) AS label), k AS (SELECT label, count(*) FILTER (pred = label AND truth = label) AS tp, count(*) FILTER (pred = label) AS np, count(*) FILTER (truth = label) AS nt FROM t CROSS JOIN p GROUP BY label)
SELECT label, round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (np + nt), 6) AS f1, nt AS support FROM k""")
def a29_precision_recall(spark, sf):
    e = table(spark, sf, "events")
    pred = F.when(F.col("value") > 50, "a").when(F.col("value") > 20, "b").otherwise("c")
    truth = F.element_at(F.array(*[F.lit(x) for x in "abc"]), (F.col("user_id") % 3 + 1).cast("int"))
    # each row counts once under its prediction and once under its truth
    both = e.select(pred.alias("p"), truth.alias("t")).groupBy("p", "t").agg(F.count("*").alias("n"))
    k = both.select(F.explode(F.array(F.struct(F.col("p").alias("label"), F.lit(1).alias("is_p"), F.lit(0).alias("is_t")), F.struct(F.col("t").alias("label"), F.lit(0).alias("is_p"), F.lit(1).alias("is_t")))).alias("x"), "p", "t", "n")
    g = k.groupBy(F.col("x.label").alias("label")).agg(F.sum(F.when((F.col("p") == F.col("t")) & (F.col("x.is_p") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("x.is_p") * F.col("n")).alias("np"), F.sum(F.col("x.is_t") * F.col("n")).alias("nt"))
    return g.select("label", F.round(F.col("tp") / F.col("np"), 6).alias("precision"), F.round(F.col("tp") / F.col("nt"), 6).alias("recall"), F.round(2 * F.col("tp") / (F.col("np") + F.col("nt")), 6).alias("f1"), F.col("nt").alias("support"))


@plan("""x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL)
SELECT vec_id, round(sqrt(sum((v - m) * (v - m))), 5) AS dist FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY vec_id""")
def a30_centroid_distance(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = x.groupBy("label", "i").agg(F.avg("v").alias("m"))
    d = x.join(c, ["label", "i"])
    return d.groupBy("vec_id").agg(F.round(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))), 5).alias("dist"))
