"""Projections, filters and predicates on the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import catalogue, table
from .registry import plan


@plan("SELECT event_id, snr FROM cat WHERE band = 'low' AND snr >= 6")
def f1_band_and_snr(spark, sf):
    return catalogue(spark, sf).where((F.col("band") == "low") & (F.col("snr") >= 6)).select("event_id", "snr")


@plan("SELECT event_id, mooring FROM cat WHERE mooring IN ('m1', 'm4')")
def f2_in_set(spark, sf):
    return catalogue(spark, sf).where(F.col("mooring").isin("m1", "m4")).select("event_id", "mooring")


@plan("SELECT event_id FROM cat WHERE file_number IN (SELECT file_number FROM cat WHERE snr > 250)")
def f3_semi_join(spark, sf):
    c = catalogue(spark, sf)
    return c.join(c.where("snr > 250").select("file_number"), "file_number", "left_semi").select("event_id")


@plan("SELECT event_id FROM cat WHERE file_number NOT IN (SELECT file_number FROM cat WHERE snr > 250)")
def f4_anti_join(spark, sf):
    c = catalogue(spark, sf)
    return c.join(c.where("snr > 250").select("file_number"), "file_number", "left_anti").select("event_id")


#: Catalogue columns in the place of spectral features, for the rule labels.
_FEATURES_SQL = "SELECT event_id, snr / 100 - 1 AS spectral_slope, duration_s AS peak_freq_hz, snr AS peak_power_db, duration_s / 10 AS duration_s, snr * 2 AS bandwidth_hz, duration_s AS freq_modulation FROM cat"


def _features(c):
    return c.select("event_id", (F.col("snr") / 100 - 1).alias("spectral_slope"), F.col("duration_s").alias("peak_freq_hz"), F.col("snr").alias("peak_power_db"), (F.col("duration_s") / 10).alias("duration_s"), (F.col("snr") * 2).alias("bandwidth_hz"), F.col("duration_s").alias("freq_modulation"))


_RULES_SQL = f"""feat AS ({_FEATURES_SQL}), r AS (SELECT event_id,
  spectral_slope < -0.5 AND peak_freq_hz < 30 AND peak_power_db > 48 AND duration_s <= 3 AS tphase,
  duration_s > 3 AND peak_power_db > 48 AND peak_freq_hz < 30 AND spectral_slope < -0.2 AS icequake,
  spectral_slope > 0 AND peak_freq_hz > 100 - 40 AND bandwidth_hz > 150 AND freq_modulation > 30 AS vessel FROM feat)"""


@plan(f"{_RULES_SQL} SELECT event_id, tphase, icequake, vessel FROM r")
def f5_feature_rules(spark, sf):
    f = _features(catalogue(spark, sf))
    return f.select("event_id", rules.is_tphase().alias("tphase"), rules.is_icequake().alias("icequake"), rules.is_vessel(peak_freq=60).alias("vessel"))


@plan(f"{_RULES_SQL} SELECT event_id, CASE WHEN tphase THEN 'tphase' WHEN icequake THEN 'icequake' WHEN vessel THEN 'vessel' END AS label FROM r WHERE tphase OR icequake OR vessel")
def f6_label_priority(spark, sf):
    f = _features(catalogue(spark, sf))
    return f.select("event_id", rules.rule_label(peak_freq=60).alias("label")).where("label IS NOT NULL")


@plan("feat AS (SELECT event_id FROM cat WHERE band <> 'mid') SELECT f.event_id FROM feat f LEFT JOIN (SELECT event_id, CASE WHEN duration_s > 0 THEN duration_s END AS peak FROM cat WHERE band = 'low') c USING (event_id) WHERE c.peak <= 17")
def f7_peak_filter(spark, sf):
    c = catalogue(spark, sf)
    peak = c.where("band = 'low'").select("event_id", F.when(F.col("duration_s") > 0, F.col("duration_s")).alias("peak"))
    return c.where("band <> 'mid'").select("event_id").join(peak, "event_id", "left").where("peak <= 17").select("event_id")


@plan("SELECT event_id, 1 / nullif(duration_s, 0) AS a, CASE WHEN snr >= 1 THEN snr END AS b FROM cat WHERE duration_s <> 0 AND snr >= 1")
def f8_complete_cases(spark, sf):
    f = catalogue(spark, sf).select("event_id", F.try_divide(F.lit(1.0), F.col("duration_s")).alias("a"), F.when(F.col("snr") >= 1, F.col("snr")).otherwise(F.lit(float("nan"))).alias("b"))
    # NaN is the null of numbers: made null at the border
    return rules.nan_to_null(f, "a", "b").dropna(how="any", subset=["a", "b"])


@plan("SELECT event_id AS id, mooring AS station FROM cat")
def f9_prune_and_rename(spark, sf):
    c = catalogue(spark, sf)
    return c.select([x for x in ("event_id", "mooring", "no_such_column") if x in c.columns]).withColumnsRenamed({"event_id": "id", "mooring": "station"})


@plan("SELECT event_id, CASE WHEN snr / 100 >= 0.7 THEN 'A' WHEN snr / 100 >= 0.4 THEN 'B' ELSE 'C' END AS grade FROM cat")
def f10_grade(spark, sf):
    return catalogue(spark, sf).select("event_id", rules.grade(F.col("snr") / 100).alias("grade"))


_TIER = "n < 3 OR dist > 150 THEN 'D' WHEN res <= 1 AND stable AND n >= 4 THEN 'A' WHEN res <= 2 THEN CASE WHEN stable THEN 'B' ELSE 'C' END WHEN res <= 5 THEN 'C' ELSE 'D'"
_LOC_SQL = "loc AS (SELECT event_id, CAST(event_id % 5 + 2 AS INT) AS n, snr / 20 AS res, duration_s * 2 AS dist, event_id % 3 <> 0 AS stable, mooring FROM cat)"


def _locations(c):
    return c.select("event_id", (F.col("event_id") % 5 + 2).cast("int").alias("n"), (F.col("snr") / 20).alias("res"), (F.col("duration_s") * 2).alias("dist"), (F.col("event_id") % 3 != 0).alias("stable"), "mooring")


@plan(f"{_LOC_SQL} SELECT event_id, CASE WHEN {_TIER} END AS tier FROM loc")
def f11_quality_tier(spark, sf):
    return _locations(catalogue(spark, sf)).select("event_id", rules.tier(F.col("n"), F.col("res"), F.col("dist"), F.col("stable")).alias("tier"))


@plan(f"""{_LOC_SQL}, t AS (SELECT *, CASE WHEN {_TIER} END AS tier FROM loc) SELECT event_id, CASE WHEN tier = 'A' AND n >= 5 AND res < 1 THEN 'excellent' WHEN tier = 'A' THEN 'very good'
  WHEN n >= 4 AND res < 2 THEN 'good' WHEN n >= 4 THEN 'fair' WHEN n = 3 AND res < 0.5 THEN 'moderate' WHEN n = 3 AND res < 2 THEN 'uncertain' ELSE 'poor' END AS bin FROM t""")
def f12_quality_bin(spark, sf):
    t = _locations(catalogue(spark, sf)).withColumn("tier", rules.tier(F.col("n"), F.col("res"), F.col("dist"), F.col("stable")))
    return t.select("event_id", rules.quality_bin(F.col("tier"), F.col("n"), F.col("res")).alias("bin"))


@plan("SELECT event_id, CASE event_type WHEN 'click' THEN 'seismic' WHEN 'view' THEN 'seismic' WHEN 'error' THEN 'vessel' ELSE event_type END AS label FROM cat")
def f13_recode(spark, sf):
    return catalogue(spark, sf).select("event_id", rules.recode(F.col("event_type"), {"click": "seismic", "view": "seismic", "error": "vessel"}).alias("label"))


@plan("SELECT event_id, CASE WHEN band = 'mid' AND snr > 100 THEN 100 ELSE snr END AS snr FROM cat")
def f14_masked_update(spark, sf):
    return catalogue(spark, sf).select("event_id", F.when((F.col("band") == "mid") & (F.col("snr") > 100), 100.0).otherwise(F.col("snr")).alias("snr"))


@plan("""a AS (SELECT event_id, snr - 180 AS az FROM cat WHERE snr <= 360) SELECT event_id, CASE WHEN az >= -22.5 AND az < 22.5 THEN 'N' WHEN az >= 22.5 AND az < 67.5 THEN 'NE' WHEN az >= 67.5 AND az < 112.5 THEN 'E'
  WHEN az >= 112.5 AND az < 157.5 THEN 'SE' WHEN az >= 157.5 OR az < -157.5 THEN 'S' WHEN az < -112.5 THEN 'SW' WHEN az < -67.5 THEN 'W' ELSE 'NW' END AS sector FROM a""")
def f15_azimuth_sector(spark, sf):
    return catalogue(spark, sf).where("snr <= 360").select("event_id", rules.sector(F.col("snr") - 180).alias("sector"))


@plan("SELECT event_id FROM cat WHERE snr / 100 >= 0.15 AND (duration_s - 50) / 10 <= 0 AND abs((duration_s - 50) / 10) <= 0.95 * 5")
def f16_valid_pick(spark, sf):
    c = catalogue(spark, sf)
    return c.where(rules.valid_pick((F.col("duration_s") - 50) / 10, F.col("snr") / 100, F.lit(5.0))).select("event_id")


@plan("SELECT mooring, band, count(*) AS n FROM cat WHERE event_id % 7 <> 3 GROUP BY mooring, band UNION ALL SELECT event_type, 'all', count(*) FROM cat GROUP BY event_type")
def u1_union_by_name(spark, sf):
    c = catalogue(spark, sf)
    a = c.where("event_id % 7 <> 3").groupBy("mooring", "band").agg(F.count("*").alias("n"))
    b = c.groupBy(F.col("event_type").alias("mooring")).agg(F.count("*").alias("n"))
    return a.unionByName(b, allowMissingColumns=True).fillna("all", ["band"])


@plan("""a AS (SELECT file_number FROM cat WHERE snr > 200), b AS (SELECT file_number FROM cat WHERE duration_s > 97)
SELECT 'union' AS op, file_number FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', file_number FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'difference', file_number FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def u2_id_sets(spark, sf):
    c = catalogue(spark, sf)
    a, b = c.where("snr > 200").select("file_number"), c.where("duration_s > 97").select("file_number")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "difference": a.exceptAll(a.intersect(b)).distinct().join(b, "file_number", "left_anti")}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("op"), "file_number")
        out = df if out is None else out.unionByName(df)
    return out


_SETS_SQL = "s AS (SELECT onset_us // 600000000 AS part, list(DISTINCT mooring) AS m FROM cat GROUP BY onset_us // 600000000)"


@plan(f"""{_SETS_SQL} SELECT a.part, round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))), 6) AS jaccard FROM s a JOIN s b ON b.part = a.part + 1""")
def u3_set_jaccard(spark, sf):
    """Stations heard in ten minutes and in the next ten."""
    s = catalogue(spark, sf).groupBy(F.floor(F.col("onset_us") / 600_000_000).alias("part")).agg(F.collect_set("mooring").alias("m"))
    b = s.select((F.col("part") - 1).alias("part"), F.col("m").alias("other"))
    return s.join(b, "part").select("part", F.round(rules.jaccard("m", "other"), 6).alias("jaccard"))


@plan("a AS (SELECT *, 1 AS batch FROM cat WHERE event_id % 2 = 0 UNION ALL SELECT *, 2 FROM cat WHERE event_id % 3 = 0) SELECT event_id, max(batch) AS batch FROM a GROUP BY event_id")
def u4_concat_keep_last(spark, sf):
    c = catalogue(spark, sf)
    both = c.where("event_id % 2 = 0").withColumn("batch", F.lit(1)).unionByName(c.where("event_id % 3 = 0").withColumn("batch", F.lit(2)))
    return both.groupBy("event_id").agg(F.max_by("batch", "batch").alias("batch"))


@plan("""SELECT o_orderpriority AS priority, c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1997-01-01' GROUP BY ALL""")
def s6_parquet_scan(spark, sf):
    o = table(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1997-01-01 00:00:00'").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return o.join(c, "o_custkey").groupBy(F.col("o_orderpriority").alias("priority"), "segment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
