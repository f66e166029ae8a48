"""Places on a map: counts by cell and zoom, and photos within a distance.

The map is cut into cells of a quadtree: at zoom z 2^z columns of longitude and 2^z rows of latitude. Photos are kept in a
Parquet table partitioned by their cell at a coarse zoom and sorted by the interleaved bits of column and row within, so
that a search reads the partitions that its circle can touch, and in them the row groups whose latitudes and longitudes fit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINEST, COARSE = 16, 4
RADIUS_KM = 6371.0088


def located(exif: DataFrame) -> DataFrame:
    """photo_id, lat and lon of the rows whose GPS texts are numbers on the map; 180 degrees east are 180 west."""
    lat, lon = F.col("gps_latitude").try_cast("double"), F.col("gps_longitude").try_cast("double")
    rows = exif.select("photo_id", lat.alias("lat"), lon.alias("lon")).where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
    return rows.withColumn("lon", F.when(F.col("lon") == 180.0, -180.0).otherwise(F.col("lon")))


def column_of(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * (1 << zoom)).cast("int")


def row_of(lat: Column, zoom: int) -> Column:
    return F.least(F.floor((lat + 90.0) / 180.0 * (1 << zoom)), F.lit((1 << zoom) - 1)).cast("int")


def counts(points: DataFrame, finest: int = FINEST) -> DataFrame:
    """zoom, x, y and photos of every cell that has any, from zoom 0 to the finest. Points are counted once, by finest
    cell; coarser cells are sums of these."""
    cells = points.groupBy(column_of(F.col("lon"), finest).alias("x"), row_of(F.col("lat"), finest).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    every = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("zoom"))
    shifted = every.select("zoom", F.expr(f"shiftright(x, {finest} - zoom)").alias("x"), F.expr(f"shiftright(y, {finest} - zoom)").alias("y"), "n")
    return shifted.groupBy("zoom", "x", "y").agg(F.sum("n").alias("photos"))


def write(points: DataFrame, path: str, coarse: int = COARSE) -> None:
    """Keeps points (photo_id, lat, lon) in a new folder. A cell with very many of them is several files."""
    x, y = column_of(F.col("lon"), FINEST), row_of(F.col("lat"), FINEST)
    bits = [(F.shiftright(c, i).bitwiseAND(F.lit(1)).cast("long"), 2 * i + odd) for i in range(FINEST) for odd, c in enumerate((x, y))]
    order = bits[0][0]
    for bit, at in bits[1:]:
        order = order.bitwiseOR(F.shiftleft(bit, at))
    cell = row_of(F.col("lat"), coarse) * (1 << coarse) + column_of(F.col("lon"), coarse)
    placed = points.withColumn("_z", order).withColumn("cell", cell)
    placed.repartitionByRange("cell", "_z").sortWithinPartitions("cell", "_z").drop("_z").write.partitionBy("cell").parquet(path)


def _box(lat: float, lon: float, km: float) -> tuple[float, float, list[tuple[float, float]]]:
    """The latitudes and the ranges of longitude that a circle touches: two where it crosses 180 degrees."""
    r = km / RADIUS_KM
    south, north = lat - math.degrees(r), lat + math.degrees(r)
    if south <= -90 or north >= 90 or r >= math.pi / 2:
        return max(south, -90.0), min(north, 90.0), [(-180.0, 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(r) / math.cos(math.radians(lat)))))
    west, east = lon - wide, lon + wide
    if east - west >= 360:
        return south, north, [(-180.0, 180.0)]
    if west < -180:
        return south, north, [(west + 360, 180.0), (-180.0, east)]
    return south, north, [(west, 180.0), (-180.0, east - 360)] if east > 180 else [(west, east)]


def distance(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Kilometres on a sphere."""
    a = F.pow(F.sin(F.radians(lat - to_lat) / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(to_lat)) * F.pow(F.sin(F.radians(lon - to_lon) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within(spark: SparkSession, path: str, lat: float, lon: float, km: float, coarse: int = COARSE) -> DataFrame:
    """photo_id, lat, lon and km of the kept points that lie so near. coarse: that of `write`."""
    slack = 1e-9
    south, north, sides = _box(lat, lon, km)
    n = 1 << coarse
    rows = range(max(0, math.floor((south - slack + 90) / 180 * n)), min(n - 1, math.floor((north + slack + 90) / 180 * n)) + 1)
    columns = {x for west, east in sides for x in range(max(0, math.floor((west - slack + 180) / 360 * n)), min(n - 1, math.floor((east + slack + 180) / 360 * n)) + 1)}
    points = spark.read.schema("photo_id long, lat double, lon double, cell int").parquet(path)
    side = F.lit(False)
    for west, east in sides:
        side |= F.col("lon").between(west - slack, east + slack)
    near = points.where(F.col("cell").isin([y * n + x for y in rows for x in sorted(columns)]) & F.col("lat").between(south - slack, north + slack) & side)
    return near.drop("cell").withColumn("km", distance(F.col("lat"), F.col("lon"), lat, lon)).where(F.col("km") <= km)
