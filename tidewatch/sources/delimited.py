"""Tables as text: catalogues separated by commas or white space, and sinks with a preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: The classes of the analyst's notes, the token at which notes begin (from 1), the fewest tokens, the rows of a preview.
CLASSES, NOTES_AT, TOKENS, PREVIEW = ("EQ", "IQ", "IDK", "SS"), 11, 11, 200


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file with a header; columns without a name, and those that another program has named "Unnamed: n", are dropped."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    return df.drop(*[c for c in df.columns if c.strip() == "" or c.startswith("Unnamed") or c.startswith("_c") and c[2:].isdigit()])


def write(df: DataFrame, path: str, *order: str | Column) -> None:
    """The whole table as Parquet at path.parquet, and its first rows in the given order as one CSV file with a header at path.csv; both replace what is there."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    spark = df.sparkSession
    # of each partition as many rows as the preview has, and of these the first
    spark.read.parquet(f"{path}.parquet").orderBy(*order).limit(PREVIEW).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def tokens(lines: DataFrame, column: str = "value") -> DataFrame:
    """With tok: the line's tokens between white space; lines with too few are left out."""
    return lines.withColumn("tok", F.filter(F.split(column, r"\s+"), lambda x: x != "")).where(F.size("tok") >= TOKENS)


def analyst_class(tok: str = "tok") -> Column:
    """The first of the notes' tokens that is a class, in capitals; else "other"."""
    hit = F.filter(F.transform(F.slice(tok, NOTES_AT, F.size(tok)), F.upper), lambda x: x.isin(*CLASSES))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit("other"))


def analyst_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of the analyst's catalogue: stamp, number of stations, their order, place, two errors, residual, two more tokens, and notes.

    (onset_us, n_moorings, arrival_order, first_mooring, lat, lon, residual, analyst_class, notes). A line with fewer than eleven tokens, a stamp
    shorter than fourteen characters, or one of the numbers no number is left out.
    """
    t = tokens(lines, column)
    out = t.select(
        text.compact_micros(F.col("tok")[0]).alias("onset_us"), F.col("tok")[1].try_cast("int").alias("n_moorings"), F.col("tok")[2].alias("arrival_order"), F.concat(F.lit("m"), F.substring(F.col("tok")[2], 1, 1)).alias("first_mooring"),
        F.col("tok")[3].try_cast("double").alias("lat"), F.col("tok")[4].try_cast("double").alias("lon"), F.col("tok")[5].try_cast("double").alias("_e1"), F.col("tok")[6].try_cast("double").alias("_e2"), F.col("tok")[7].try_cast("double").alias("residual"),
        analyst_class().alias("analyst_class"), F.array_join(F.slice("tok", NOTES_AT, F.size("tok")), " ").alias("notes"),
    )
    return out.dropna(subset=["onset_us", "n_moorings", "lat", "lon", "_e1", "_e2", "residual"]).drop("_e1", "_e2")


def observed(catalogue: DataFrame, column: str = "date") -> DataFrame:
    """With onset_us of a count of days since year 0."""
    return catalogue.withColumn("onset_us", text.from_datenum(F.col(column)))
