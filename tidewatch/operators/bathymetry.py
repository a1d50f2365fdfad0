"""Layers of gridded depths: each interpolated at any place, the layer of highest priority that knows the place taken.

A layer's cells are packed into square tiles, which carry the first row and column of their neighbours, so that a place meets one tile of a layer
and finds the four cells around it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells a side of a tile.
SIDE = 64
#: A row each of these is broadcast.
MOST_LAYERS = 1000
LAYERS = "layer string, priority int, lat0 double, lon0 double, dlat double, dlon double, n_lat int, n_lon int"


def tiles(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(layer, i, j, z) to (layer, ti, tj, z map of place to depth). A tile has (side + 1) squared cells at most; of repeated cells the least counts."""

    def homes(c: str) -> Column:
        # a first row or column is the last one of the tile before as well
        own = F.floor(F.col(c) / side)
        return F.when((F.col(c) % side == 0) & (F.col(c) > 0), F.array(own, own - 1)).otherwise(F.array(own))

    known = cells.where("i IS NOT NULL AND j IS NOT NULL AND z IS NOT NULL AND NOT isnan(z)").groupBy("layer", "i", "j").agg(F.min("z").alias("z"))
    dealt = known.withColumn("ti", F.explode(homes("i"))).withColumn("tj", F.explode(homes("j")))
    place = ((F.col("i") - F.col("ti") * side) * (side + 1) + F.col("j") - F.col("tj") * side).cast("int")
    return dealt.groupBy("layer", "ti", "tj").agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("z")))).alias("z"))


def at_points(points: DataFrame, layers: DataFrame, cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(id, lat, lon) with (layer, z): the depth between the four cells around each place, in the layer of highest priority that has all four.

    layers: LAYERS, a row each, of which there are a few; cells: (layer, i, j, z), i counts latitudes and j longitudes from the layer's corner. The
    layer's outer rows and columns belong to it. Places that no layer knows, or that are null, have null.
    """
    within = F.col("lat").between(F.col("lat0"), F.col("lat0") + (F.col("n_lat") - 1) * F.col("dlat")) & F.col("lon").between(F.col("lon0"), F.col("lon0") + (F.col("n_lon") - 1) * F.col("dlon"))
    if layers.count() > MOST_LAYERS:
        raise ValueError(f"more than {MOST_LAYERS} layers")
    where = points.select("id", "lat", "lon").join(F.broadcast(layers), within)
    fi, fj = (F.col("lat") - F.col("lat0")) / F.col("dlat"), (F.col("lon") - F.col("lon0")) / F.col("dlon")
    at = where.withColumn("i", F.least(F.floor(fi), F.col("n_lat") - 2).cast("long")).withColumn("j", F.least(F.floor(fj), F.col("n_lon") - 2).cast("long")).withColumn("u", fi - F.col("i")).withColumn("v", fj - F.col("j"))
    met = at.withColumn("ti", F.floor(F.col("i") / side)).withColumn("tj", F.floor(F.col("j") / side)).join(tiles(cells, side), ["layer", "ti", "tj"])

    def corner(di: int, dj: int) -> Column:
        return F.try_element_at("z", ((F.col("i") + di - F.col("ti") * side) * (side + 1) + F.col("j") + dj - F.col("tj") * side).cast("int"))

    u, v = F.col("u"), F.col("v")
    z = corner(0, 0) * (1 - u) * (1 - v) + corner(1, 0) * u * (1 - v) + corner(0, 1) * (1 - u) * v + corner(1, 1) * u * v
    best = met.select("id", "priority", "layer", z.alias("z")).where("z IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("layer", "z"), F.struct("priority", "layer")).alias("b")).select("id", "b.layer", "b.z")
    return points.join(best, "id", "left")
