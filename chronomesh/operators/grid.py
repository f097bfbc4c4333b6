"""Hex grid of anchors and the mesh between them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, KM_PER_LNG_GRID, rounded, segment_km
from . import polygons, spatial
from .shared import settle

#: South, north, west, east of the city, and the spacing of rows in degrees.
BOX, ROW = (47.5, 47.734, -122.43, -122.24), 0.0045
#: Latitude and longitude of the bridges (fixed values).
BRIDGES = (
    ("Ballard Bridge", 47.6598, -122.3764), ("Fremont Bridge", 47.6476, -122.3497), ("Aurora Bridge", 47.6462, -122.3476),
    ("University Bridge", 47.6529, -122.3205), ("Montlake Bridge", 47.6473, -122.3045), ("West Seattle Bridge", 47.5706, -122.3524),
    ("1st Ave S Bridge", 47.5422, -122.334),
)
#: Reach of land edges and of crossings in rows, and how near to a bridge a crossing passes in km.
LAND_STEPS, CROSSING_STEPS, BRIDGE_KM, PER_BRIDGE = 1.6, 4.5, 0.35, 2


def column_spacing(box=BOX, row: float = ROW) -> float:
    return row / math.cos(math.radians((box[0] + box[1]) / 2)) * 2 / math.sqrt(3)


def grid_points(spark: SparkSession, box=BOX, row: float = ROW) -> DataFrame:
    """(row, col, lat, lng) of all points of the box, odd rows half a column further east.

    Coordinates are sums of steps, not multiples, because where the last row and column
    fall depends on it.
    """
    south, north, west, east = box
    col = column_spacing(box, row)
    steps = lambda start, stop, by: F.aggregate(F.sequence(F.lit(1), F.lit(int((stop - start) / by) + 2)), F.array(start if isinstance(start, F.Column) else F.lit(start)), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + by)))
    rows = spark.range(1).select(F.posexplode(steps(south, north, row)).alias("row", "lat")).where(F.col("lat") <= north)
    shift = F.when(F.col("row") % 2 == 0, F.lit(0.0)).otherwise(F.lit(col / 2))
    n = int((east - west) / col) + 2
    lngs = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.lit(west) + shift), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + col)))
    return rows.select("row", "lat", F.posexplode(lngs).alias("col", "lng")).where(F.col("lng") <= east)


def land_anchors(points: DataFrame, water: DataFrame) -> DataFrame:
    """(id, lat, lng): points (row, col, lat, lng) outside all rings, numbered along the rows."""
    from pyspark.sql import Window

    named = points.withColumn("id", F.col("row") * 100_000 + F.col("col"))
    dry = named.join(polygons.in_rings(named.select("id", "lat", "lng"), water).select("id").distinct(), "id", "left_anti")
    per_row = dry.groupBy("row").count()
    base = per_row.select("row", F.coalesce(F.sum("count").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    return dry.withColumn("place", place).join(base, "row").select((F.col("base") + F.col("place")).cast("long").alias("id"), rounded(F.col("lat"), 6).alias("lat"), rounded(F.col("lng"), 6).alias("lng"))


def near_bridge(pairs: DataFrame, bridges=BRIDGES) -> DataFrame:
    """The pairs whose segment (lat, lng, r_lat, r_lng) passes near enough to a bridge, with bridge, the number of the nearest one.

    Distances are columns of one projection, which Spark compiles and in which it works out shared parts once; a lambda over an array
    of bridges is not compiled. The array of one element keeps the condition above the projection.
    """
    km = [segment_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng")) for _, lat, lng in bridges]
    away = pairs.select("*", *(k.alias(f"_km{i}") for i, k in enumerate(km)))
    best = F.least(*(f"_km{i}" for i in range(len(km))))
    bridge = F.lit(len(km) - 1)
    for i in reversed(range(len(km) - 1)):
        bridge = F.when(F.col(f"_km{i}") == best, F.lit(i)).otherwise(bridge)
    found = away.select(*pairs.columns, F.explode(F.array(F.when(best < BRIDGE_KM, bridge))).alias("bridge"))
    return found.where("bridge is not null")


def mesh(anchors: DataFrame, water: DataFrame, row: float = ROW) -> DataFrame:
    """(i, j, kind): 0 between neighbours on land, 1 for the two shortest crossings of each bridge."""
    right = anchors.select(F.col("id").alias("j"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    step = row * KM_PER_DEG
    pairs = spatial.within(anchors, right, CROSSING_STEPS * step, KM_PER_LNG_GRID).where(F.col("id") < F.col("j")).withColumnRenamed("id", "i")
    pairs = settle(pairs.withColumn("pair", F.xxhash64("i", "j")))
    t = F.explode(F.array(*map(F.lit, (0.2, 0.35, 0.5, 0.65, 0.8))))
    samples = pairs.withColumn("t", t).select(F.col("pair").alias("id"), (F.col("lat") + (F.col("r_lat") - F.col("lat")) * F.col("t")).alias("lat"), (F.col("lng") + (F.col("r_lng") - F.col("lng")) * F.col("t")).alias("lng"), "t")
    spot = samples.withColumn("id", F.struct("id", "t"))
    wet = polygons.in_rings(spot, water).select(F.col("id.id").alias("pair")).distinct()
    land = pairs.where(F.col("d") <= LAND_STEPS * step).join(wet, "pair", "left_anti").select("i", "j", F.lit(0).alias("kind"))
    crossing = near_bridge(pairs.join(wet, "pair", "left_semi"))
    short = spatial.nearest(crossing, ["bridge"], PER_BRIDGE, ["d", "i", "j"]).select("i", "j", F.lit(1).alias("kind"))
    return land.unionByName(short)
