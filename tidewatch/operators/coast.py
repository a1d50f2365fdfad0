"""Distance of places from polygons, and the rule that icequakes far from the coast need ice.

Edges of polygons lie in tiles of the plane of degrees and in the tiles around these. A place looks in its tile; an edge found no further off than a tile is wide is
the nearest, as what was not looked at is further away. Places without one look again in tiles twice as wide.
Equal places, and polygons that repeat one another, are looked at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import keep

#: Km from the coast within which an icequake needs no ice, share of ice from which water is covered, tiers that have a place.
COAST_KM, ICE, TIERS = 30.0, 0.15, ("A", "B", "C")
#: Degrees of the smallest tiles.
TILE = 0.25


def edges(vertices: DataFrame) -> DataFrame:
    """(poly, seq, lat, lon) to closed polygons' edges (poly, y1, x1, y2, x2)."""
    w = Window.partitionBy("poly").orderBy("seq")
    around = F.coalesce(F.lead(F.struct("lat", "lon")).over(w), F.first(F.struct("lat", "lon")).over(w))
    return vertices.withColumn("_n", around).select("poly", F.col("lat").alias("y1"), F.col("lon").alias("x1"), F.col("_n.lat").alias("y2"), F.col("_n.lon").alias("x2"))


def _tiled(of: DataFrame, tile: float, lo_y: Column, hi_y: Column, lo_x: Column, hi_x: Column) -> DataFrame:
    def span(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / tile) - 1, F.floor(hi / tile) + 1))

    return of.withColumn("_ty", span(lo_y, hi_y)).withColumn("_tx", span(lo_x, hi_x))


def different(sides: DataFrame) -> DataFrame:
    """Edges without those of polygons that repeat another one's, which decide nothing. Polygons are told apart by 128 bits of hashes of their edges."""
    line = [F.col(c) for c in ("y1", "x1", "y2", "x2")]
    marks = [F.sum(F.xxhash64(*line, F.lit(k)).cast("decimal(38,0)")).alias(f"_h{k}") for k in (1, 2)]
    kept = sides.groupBy("poly").agg(F.count("*").alias("_n"), *marks).groupBy("_n", "_h1", "_h2").agg(F.min("poly").alias("poly"))
    return sides.join(kept.select("poly"), "poly", "left_semi")


def inside(points: DataFrame, sides: DataFrame, tile: float = TILE) -> DataFrame:
    """Ids of the points in a polygon: those east of which its edges cross the point's latitude an odd number of times."""
    strips = sides.where("y1 != y2").withColumn("_ty", F.explode(F.sequence(F.floor(F.least("y1", "y2") / tile), F.floor(F.greatest("y1", "y2") / tile))))
    met = points.select("id", "lat", "lon", F.floor(F.col("lat") / tile).alias("_ty")).join(strips, "_ty")
    crosses = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    east = F.col("lon") < F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    return met.where(crosses & east).groupBy("id", "poly").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id").distinct()


def nearest(points: DataFrame, vertices: DataFrame, tile: float = TILE) -> DataFrame:
    """(id, lat, lon) with (near_lat, near_lon, degrees): the nearest place of any polygon in the plane of degrees, which for one in a polygon is itself.

    Points without a place, and all points where there is no polygon, have null. Of equally near places the one of smallest latitude, then longitude.
    """
    sides = keep(different(edges(vertices.where("lat IS NOT NULL AND lon IS NOT NULL"))))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    places = keep(points.where(known).select("lat", "lon").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = keep(places.join(inside(places, sides, tile), "id").select("id", F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), F.lit(0.0).alias("degrees")))
    lines = keep(sides.select("y1", "x1", "y2", "x2").distinct())
    if not lines.isEmpty():
        left = places.join(found, "id", "left_anti")
        while not (left := keep(left)).isEmpty():
            asked = left.withColumn("_ty", F.floor(F.col("lat") / tile)).withColumn("_tx", F.floor(F.col("lon") / tile))
            # edges go to the tiles around theirs, as there are fewer of them than places
            indexed = _tiled(lines, tile, F.least("y1", "y2"), F.greatest("y1", "y2"), F.least("x1", "x2"), F.greatest("x1", "x2"))
            dy, dx = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
            length = dy * dy + dx * dx
            share = F.when(length > 0, ((F.col("lat") - F.col("y1")) * dy + (F.col("lon") - F.col("x1")) * dx) / length).otherwise(0.0)
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
            near = asked.join(indexed, ["_ty", "_tx"]).withColumn("near_lat", F.col("y1") + share * dy).withColumn("near_lon", F.col("x1") + share * dx)
            near = near.withColumn("degrees", F.hypot(F.col("lat") - F.col("near_lat"), F.col("lon") - F.col("near_lon"))).where(F.col("degrees") <= tile)
            best = near.groupBy("id").agg(F.min(F.struct("degrees", "near_lat", "near_lon")).alias("b")).select("id", "b.near_lat", "b.near_lon", "b.degrees")
            best = keep(best)
            found = found.unionByName(best)
            left = left.join(best, "id", "left_anti")
            tile *= 2
    return points.join(places.join(found, "id").drop("id"), ["lat", "lon"], "left").select(*points.columns, "near_lat", "near_lon", "degrees")


def coast_km(points: DataFrame, vertices: DataFrame, tile: float = TILE) -> DataFrame:
    """(id, lat, lon) with dist_to_coast_km, on the ellipsoid, to the nearest place of the plane of degrees."""

    @F.pandas_udf("double")
    def km(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(geo.inverse(a, b, c, d)[0] / 1000)

    near = nearest(points, vertices, tile)
    return near.withColumn("dist_to_coast_km", F.when(F.col("near_lat").isNotNull(), km("lat", "lon", "near_lat", "near_lon"))).drop("near_lat", "near_lon", "degrees")


def ice_rule(located: DataFrame, vertices: DataFrame, ice: DataFrame | None = None, tile: float = TILE) -> DataFrame:
    """Located events (id, lat, lon, quality_tier, event_class, month) with dist_to_coast_km, sea_ice_conc and icequake_filtered; filtered ones are unclassified.

    ice: (id, sea_ice_conc), what is known of it. Events of other tiers, or without a place, have neither distance nor ice.
    """
    placed = located.where(F.col("quality_tier").isin(*TIERS) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon")
    far = coast_km(placed, vertices, tile).select("id", "dist_to_coast_km")
    far = far.join(ice, "id", "left") if ice is not None else far.withColumn("sea_ice_conc", F.lit(None).cast("double"))
    covered = F.coalesce((F.col("sea_ice_conc") >= ICE) & ~F.isnan("sea_ice_conc"), F.lit(False))
    gone = F.coalesce((F.col("event_class") == "icequake") & (F.col("dist_to_coast_km") > COAST_KM) & ~covered, F.lit(False))
    out = located.join(far, "id", "left").withColumn("icequake_filtered", gone)
    return out.withColumn("event_class", F.when(F.col("icequake_filtered"), "unclassified").otherwise(F.col("event_class")))
