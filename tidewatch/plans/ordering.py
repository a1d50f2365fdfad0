"""Sorts, top-k, samples, scalar parsing and resumed runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import rel
from ..sources.tables import catalogue, table
from .registry import plan


@plan("SELECT event_id, row_number() OVER (PARTITION BY file_number ORDER BY band, mooring DESC, CASE WHEN snr > 50 THEN snr END ASC NULLS LAST, duration_s DESC NULLS LAST, event_id) AS rank FROM cat")
def o1_mixed_sort(spark, sf):
    c = catalogue(spark, sf).withColumn("r", F.when(F.col("snr") > 50, F.col("snr")))
    w = Window.partitionBy("file_number").orderBy(F.asc("band"), F.desc("mooring"), F.asc_nulls_last("r"), F.desc_nulls_last("duration_s"), F.asc("event_id"))
    return c.select("event_id", F.row_number().over(w).alias("rank"))


@plan("SELECT event_id, snr FROM cat ORDER BY snr DESC, event_id LIMIT 100")
def o2_top_100(spark, sf):
    return catalogue(spark, sf).orderBy(F.desc("snr"), "event_id").limit(100).select("event_id", "snr")


@plan("SELECT mooring, event_id FROM cat QUALIFY row_number() OVER (PARTITION BY mooring ORDER BY abs(snr - 50), event_id) <= 12")
def o3_top_per_group(spark, sf):
    w = Window.partitionBy("mooring").orderBy(F.abs(F.col("snr") - 50), "event_id")
    return catalogue(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 12").select("mooring", "event_id")


_PICK = "sha256(CAST(event_id AS VARCHAR))"


@plan(f"""q AS (SELECT mooring, quantile_cont(snr, [0.2, 0.4, 0.6, 0.8]) AS e FROM cat GROUP BY mooring), b AS (SELECT event_id, mooring, (snr > e[1])::INT + (snr > e[2])::INT + (snr > e[3])::INT + (snr > e[4])::INT AS bin FROM cat JOIN q USING (mooring))
SELECT mooring, CAST(bin AS BIGINT) AS bin, event_id FROM b QUALIFY row_number() OVER (PARTITION BY mooring, bin ORDER BY {_PICK}, event_id) <= 4""")
def o4_sample_by_quantile(spark, sf):
    """Four of each station's fifths, in the order of a hash in the place of a seeded generator."""
    c = catalogue(spark, sf)
    q = c.groupBy("mooring").agg(F.percentile("snr", F.array(*[F.lit(p) for p in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    b = c.join(F.broadcast(q), "mooring").withColumn("bin", F.size(F.filter("e", lambda x: F.col("snr") > x)).cast("long"))
    return _sample(b, ["mooring", "bin"], 4).select("mooring", "bin", "event_id")


def _sample(df, keys, k):
    w = Window.partitionBy(*keys).orderBy(F.sha2(F.col("event_id").cast("string"), 256), "event_id")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


@plan(f"""g AS (SELECT event_id, band, CASE WHEN snr / 100 >= 0.7 THEN 'A' WHEN snr / 100 >= 0.4 THEN 'B' ELSE 'C' END AS grade FROM cat),
f AS (SELECT *, row_number() OVER (PARTITION BY band, grade ORDER BY {_PICK}, event_id) AS k FROM g), p AS (SELECT *, k <= CASE grade WHEN 'A' THEN 8 WHEN 'B' THEN 4 ELSE 4 END AS chosen FROM f)
SELECT band, grade, event_id FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, {_PICK}, event_id) AS r FROM p) WHERE r <= 16""")
def o5_sample_by_band_and_grade(spark, sf):
    """Half A, a quarter each of B and C; what one grade lacks is filled from the others."""
    g = catalogue(spark, sf).select("event_id", "band", rules.grade(F.col("snr") / 100).alias("grade"))
    h = F.sha2(F.col("event_id").cast("string"), 256)
    k = F.row_number().over(Window.partitionBy("band", "grade").orderBy(h, "event_id"))
    p = g.withColumn("k", k).withColumn("late", F.col("k") > F.when(F.col("grade") == "A", 8).otherwise(4))
    r = F.row_number().over(Window.partitionBy("band").orderBy("late", h, "event_id"))
    return p.withColumn("r", r).where("r <= 16").select("band", "grade", "event_id")


@plan("n AS (SELECT mooring, event_id, row_number() OVER (PARTITION BY mooring ORDER BY onset_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY mooring) AS n FROM cat), k AS (SELECT unnest(range(10)) AS k) SELECT DISTINCT mooring, event_id FROM n JOIN k ON i = k * (n - 1) // 9")
def o6_evenly_spaced(spark, sf):
    c = catalogue(spark, sf).withColumn("i", (F.row_number().over(Window.partitionBy("mooring").orderBy("onset_us", "event_id")) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("mooring")))
    at = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.floor(k * (F.col("n") - 1) / 9))
    return c.where(F.array_contains(at, F.col("i"))).select("mooring", "event_id")


@plan(f"SELECT event_id FROM cat ORDER BY {_PICK}, event_id LIMIT 3000")
def o8_random_subsample(spark, sf):
    return catalogue(spark, sf).orderBy(F.sha2(F.col("event_id").cast("string"), 256), "event_id").limit(3000).select("event_id")


@plan("""d AS (SELECT event_id, printf('%04d %03d:%02d:%02d:%02d:%03d', CAST(year(ts) - 1900 AS INT), CAST(dayofyear(ts) AS INT), CAST(hour(ts) AS INT), CAST(minute(ts) AS INT), CAST(second(ts) AS INT), CAST((microsecond(ts) // 1000) % 1000 AS INT)) AS raw, epoch_us(date_trunc('second', ts)) + ((microsecond(ts) // 1000) % 1000) * 1000 AS us FROM events) SELECT event_id, raw, us FROM d""")
def s3_header_timestamp(spark, sf):
    """Times written as the recorder does (years since 1900, day of year, milliseconds) and parsed back."""
    e = table(spark, sf, "events")
    raw = F.concat_ws(" ", F.lpad((F.year("ts") - 1900).cast("string"), 4, "0"), F.concat_ws(":", F.lpad(F.dayofyear("ts").cast("string"), 3, "0"), F.date_format("ts", "HH:mm:ss:SSS")))
    return e.select("event_id", raw.alias("raw")).select("event_id", "raw", text.recorder_micros(F.col("raw")).alias("us"))


@plan("""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[ \\t]+'), lambda x: x <> '') AS tok FROM l)
SELECT doc_id, count(*) AS kept, count(*) FILTER (len(tok[1]) >= 4) AS long_first, count(*) FILTER (list_contains(tok[10:], 'the')) AS marked FROM t WHERE len(tok) >= 11 GROUP BY doc_id""")
def s8_whitespace_lines(spark, sf):
    """Lines of at least eleven tokens; others are skipped."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    t = lines.select("doc_id", F.filter(F.split("line", "[ \t]+"), lambda x: x != "").alias("tok")).where(F.size("tok") >= 11)
    return t.groupBy("doc_id").agg(F.count("*").alias("kept"), F.count_if(F.length(F.element_at("tok", 1)) >= 4).alias("long_first"), F.count_if(F.array_contains(F.slice("tok", 10, 1_000_000), "the")).alias("marked"))


@plan("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def s10_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k IS NOT NULL")


@plan("done AS (SELECT DISTINCT mooring, file_number FROM cat WHERE file_number % 3 = 0) SELECT c.mooring, c.file_number, count(*) AS n FROM cat c ANTI JOIN done d ON c.mooring = d.mooring AND c.file_number = d.file_number GROUP BY ALL")
def s16_resume(spark, sf):
    c = catalogue(spark, sf)
    return rel.unfinished(c, c.where("file_number % 3 = 0"), ["mooring", "file_number"]).groupBy("mooring", "file_number").agg(F.count("*").alias("n"))


@plan(r"""SELECT doc_id, coalesce(list_sum([CAST(x AS BIGINT) for x in regexp_extract_all(text, '(\d+)\s', 1) if length(x) < 10])::BIGINT, 0) AS total, len(regexp_extract_all(text, '(\d+)\s', 1)) AS hits FROM documents WHERE regexp_matches(text, '\d\s')""")
def x1_regex_sums(spark, sf):
    """Numbers found by a pattern, summed over all matches."""
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"\d\s"))
    found = F.regexp_extract_all("text", F.lit(r"(\d+)\s"), F.lit(1))
    return d.select("doc_id", text.sum_of(F.filter(found, lambda x: F.length(x) < 10)).alias("total"), F.size(found).alias("hits"))


@plan("SELECT conv_id, turn, regexp_matches(lower(text), 'idiot|loser|the') AS has_any FROM conversations")
def x2_contains_any(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.contains_any(F.col("text"), "idiot", "loser", "the").alias("has_any"))


@plan("SELECT event_id, strftime(ts, '%Y%j%H%M%S') AS compact, CAST(epoch_us(ts) AS DOUBLE) / 86400000000 + 719529 AS datenum, strftime(ts, '%Y-%m') AS month FROM events")
def x3_date_forms(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.date_format("ts", "yyyyDDDHHmmss").alias("compact"), text.datenum("ts").alias("datenum"), F.date_format("ts", "yyyy-MM").alias("month"))


@plan("SELECT event_id, round(15 * log10(greatest(duration_s * 1000, 100)) + snr, 6) AS level, round_even(snr, 1) AS rounded, greatest(least(snr, 100), 10) AS clipped FROM cat")
def x4_level_and_rounding(spark, sf):
    """Source level from received level and distance; Python's rounding is half to even."""
    c = catalogue(spark, sf)
    return c.select("event_id", F.round(text.source_level(F.col("snr"), F.col("duration_s") * 1000), 6).alias("level"), F.bround("snr", 1).alias("rounded"), F.greatest(F.least("snr", F.lit(100.0)), F.lit(10.0)).alias("clipped"))
