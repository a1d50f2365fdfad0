"""Sound-speed profiles in three dialects of text, a file a profile, as plans of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a file of the second dialect begins with, and the third; lines before the second's rows; an accepted profile's points and depth.
BRACKETS, PARENTHESIS, SECOND_HEADER, POINTS, DEEP_M = "[SVP_VERSION_2]", "(", 3, 10, 100.0


def lines(spark: SparkSession, path: str, glob: str = "*.asvp") -> DataFrame:
    """(source, dialect, lines array<string>) of each file, without white space around the text; empty files are left out."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    body = F.regexp_replace(F.regexp_replace("value", r"^\s+", ""), r"\s+$", "")
    t = whole.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source"), F.split(body, r"\r\n|\r|\n").alias("lines")).where(F.col("lines")[0] != "")
    first = F.trim(F.col("lines")[0])
    return t.withColumn("dialect", F.when(F.startswith(first, F.lit(BRACKETS)), "svp2").when(F.startswith(first, F.lit(PARENTHESIS)), "soundvelocity").otherwise("csv"))


def _value(of: Column, name: str) -> Column:
    """What stands after the first comma of the last line before the rows that begins with a name."""
    hit = F.filter(of, lambda x: F.startswith(F.trim(x), F.lit(name)))
    return F.trim(F.try_element_at(F.split(F.try_element_at(hit, F.lit(-1)), ","), F.lit(2)))


def read(spark: SparkSession, path: str, glob: str = "*.asvp") -> DataFrame:
    """A row for each file: (source, dialect, date, time, lat, lon, lat_dms, lon_dms, points array of (depth, speed), accepted).

    The comma dialect's rows follow a line that begins with depth, or are all lines if there is none; the others' follow their headers. Lines
    without two numbers are skipped. A profile of more than POINTS points whose last is deeper than DEEP_M is accepted.
    """
    t = lines(spark, path, glob)
    csv, svp2 = F.col("dialect") == "csv", F.col("dialect") == "svp2"
    depth_line = F.coalesce(F.expr("array_position(transform(lines, x -> startswith(trim(x), 'depth')), true)"), F.lit(0)).cast("int")
    skip = F.when(csv, depth_line).when(svp2, SECOND_HEADER).otherwise(1)
    t = t.withColumn("_skip", skip)
    head = F.when(F.col("_skip") > 0, F.slice("lines", 1, F.greatest("_skip", F.lit(1)))).otherwise(F.col("lines"))
    t = t.withColumn("_head", head).withColumn("_body", F.slice("lines", F.col("_skip") + 1, F.size("lines")))
    t = t.withColumn("_section", F.when(svp2 & (F.size("lines") >= 3), F.split(F.trim(F.col("lines")[2]), r"\s+"))).withColumn("_first", F.when(F.col("dialect") == "soundvelocity", F.split(F.regexp_replace(F.trim(F.col("lines")[0]), r"^[() ]+|[() ]+$", ""), r"\s+")))
    section, first = F.when(F.size("_section") >= 5, F.col("_section")), F.when(F.size("_first") >= 6, F.col("_first"))

    def part(i: int) -> Column:
        return F.expr(f"transform(_body, x -> try_cast(trim(CASE WHEN dialect = 'csv' THEN try_element_at(split(x, ','), {i}) ELSE try_element_at(split(trim(x), '\\\\s+'), {i}) END) AS DOUBLE))")

    points = F.filter(F.arrays_zip(part(1).alias("depth"), part(2).alias("speed")), lambda p: p["depth"].isNotNull() & p["speed"].isNotNull())
    t = t.withColumn("points", points)
    return t.select(
        "source", "dialect",
        F.when(csv, _value(F.col("_head"), "Date")).otherwise(section[1]).alias("date"), F.when(csv, _value(F.col("_head"), "Time")).otherwise(section[2]).alias("time"),
        F.when(csv, _value(F.col("_head"), "Latitude").try_cast("double")).otherwise(first[4].try_cast("double")).alias("lat"), F.when(csv, _value(F.col("_head"), "Longitude").try_cast("double")).otherwise(first[5].try_cast("double")).alias("lon"),
        section[3].alias("lat_dms"), section[4].alias("lon_dms"), "points",
        F.coalesce((F.size("points") > POINTS) & (F.try_element_at("points", F.lit(-1))["depth"] > DEEP_M), F.lit(False)).alias("accepted"),
    )
