"""Distances and tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the earth in metres (fixed value).
RADIUS = 6371000.0
ZOOM = 14


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance in metres."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * RADIUS


def move_north(lat: Column, metres: float) -> Column:
    """The latitude so many metres further; as in the model this subtracts."""
    return lat - F.lit(math.degrees(metres / RADIUS))


def move_east(lon: Column, lat: Column, metres: float) -> Column:
    return lon + F.degrees(F.lit(metres / RADIUS) / F.cos(F.radians(lat)))


def tile_of(lon: Column, lat: Column, zoom: int = ZOOM) -> tuple[Column, Column]:
    """Slippy-map tile (x, y)."""
    n = float(2**zoom)
    rad = F.radians(lat)
    return F.floor((lon + 180.0) / 360.0 * n).cast("int"), F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n).cast("int")


def tile_north_west(x: Column, y: Column, zoom: int = ZOOM) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = float(2**zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n))))


def tile_size(x: Column, y: Column, zoom: int = ZOOM) -> tuple[Column, Column]:
    """Width and height of a tile in metres."""
    west, north = tile_north_west(x, y, zoom)
    east, south = tile_north_west(x + 1, y + 1, zoom)
    return distance_m(west, north, east, north), distance_m(west, north, west, south)


def with_tile(stops: DataFrame, zoom: int = ZOOM) -> DataFrame:
    x, y = tile_of(F.col("lon"), F.col("lat"), zoom)
    return stops.withColumns({"tile_x": x, "tile_y": y})


def in_box(stops: DataFrame, west: float, south: float, east: float, north: float, zoom: int = ZOOM) -> DataFrame:
    """Stops in the tiles that cover the box."""
    corner = lambda lon, lat: tile_of(F.lit(lon), F.lit(lat), zoom)
    (x0, y0), (x1, y1) = corner(west, north), corner(east, south)
    return with_tile(stops, zoom).where(F.col("tile_x").between(x0, x1) & F.col("tile_y").between(y0, y1)).drop("tile_x", "tile_y")


#: A longitude step is never shorter than at this latitude; stops beyond it are not supported.
MOST_LATITUDE = 85.0


def pairs_in_range(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(from_stop, to_stop, dist) of all stops of left and right within metres of each other, as an equi-join on grid cells.

    A cell is as high as the range, and as wide at its latitude band; each left stop looks into the cells around its own. Cells depend on
    rows of latitude alone, so neighbouring bands are looked up with the width of the band in question.
    """
    step = math.degrees(max(metres, 1.0) / RADIUS) * 1.0001
    band = lambda lat: F.floor(lat / step).cast("long")
    widest = lambda b: F.least(F.abs(b), F.abs(b + 1)) * step + step
    # Width of a band's cells: the range at the band's latitude furthest from the equator, and one band more.
    width = lambda b: F.lit(step) / F.cos(F.radians(F.least(widest(b) + step, F.lit(89.0))))
    r = right.select(F.col("stop_id").alias("to_stop"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat")).withColumn("by", band(F.col("to_lat")))
    r = r.withColumn("bx", F.floor(F.col("to_lon") / width(F.col("by"))).cast("long"))
    near = left.select(F.col("stop_id").alias("from_stop"), F.col("lon").alias("from_lon"), F.col("lat").alias("from_lat"))
    near = near.withColumn("by", F.explode(F.sequence(band(F.col("from_lat")) - 1, band(F.col("from_lat")) + 1)))
    near = near.withColumn("cx", F.floor(F.col("from_lon") / width(F.col("by"))).cast("long"))
    near = near.withColumn("bx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    dist = distance_m(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))
    return near.join(r, ["bx", "by"]).withColumn("dist", dist).where(F.col("dist") <= metres).select("from_stop", "to_stop", "dist")


def in_range(stops: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Stops within metres of a place, with dist. The box around it is compared first, so that scans can skip."""
    dlat = math.degrees(metres / RADIUS) * 1.0001
    dlon = dlat / max(math.cos(math.radians(min(abs(lat) + dlat, 89.9))), 1e-6)
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)
    return stops.where(box).withColumn("dist", distance_m(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))).where(F.col("dist") <= metres)


def find_closest(stops: DataFrame, lon: float, lat: float, metres: float = 1000.0) -> DataFrame:
    """The nearest stop in range, ties by id; no row if there is none."""
    near = in_range(stops, lon, lat, metres)
    return near.agg(F.min(F.struct("dist", "stop_id")).alias("best")).where("best IS NOT NULL").select(F.col("best.stop_id").alias("stop_id"), F.col("best.dist").alias("dist"))


def bounding_box(stops: DataFrame) -> DataFrame:
    return stops.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
