"""Writers: CSV of stops, trips and connections, routes, tiles, map relations, itineraries."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bounding_box
from ..model import Snapshot
from ..operators.aggregates import attribute_keys, edge_stats, relation_members, route_merge, stop_stats, trip_routes


def with_attributes(rows: DataFrame) -> DataFrame:
    """The attributes as columns of their own, in order of their keys. Keys are names of columns: there are few."""
    keys = [r["key"] for r in attribute_keys(rows).collect()]
    return rows.select(*[c for c in rows.columns if c != "attributes"], *[F.col("attributes")[k].alias(k) for k in keys])


def stops_table(snap: Snapshot) -> DataFrame:
    rows = snap.stops.select(F.col("stop_id").alias("globalId"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), "attributes")
    return with_attributes(rows)


def trips_table(snap: Snapshot) -> DataFrame:
    return with_attributes(snap.trips.select(F.col("trip_id").alias("GlobalId"), "attributes"))


def connections_table(snap: Snapshot, human: bool = False) -> DataFrame:
    """Connections with names of stops and trip; human: times of day only."""
    name = lambda end: snap.stops.select(F.col("stop_id").alias(f"{end}_stop"), F.coalesce(F.col("attributes")["name"], F.lit("")).alias(f"{end}_name"))
    trip = snap.trips.select("trip_id", F.col("attributes")["headsign"].alias("headsign"), F.col("attributes")["route"].alias("route"))
    rows = snap.connections.join(name("dep"), "dep_stop", "left").join(name("arr"), "arr_stop", "left").join(trip, "trip_id", "left")
    clock = lambda c: F.date_format(F.timestamp_seconds(c), "HH:mm" if human else "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if human:
        return rows.select("conn_id", "dep_name", clock("dep_time").alias("departure"), "arr_name", clock("arr_time").alias("arrival"), "travel_time", "headsign", "route", "mode")
    return rows.select("conn_id", "dep_stop", "dep_name", clock("dep_time").alias("departure"), "arr_stop", "arr_name", clock("arr_time").alias("arrival"), "travel_time", "mode", "trip_id", "headsign")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quoteAll=False, escape='"')


def routes_table(snap: Snapshot) -> DataFrame:
    """Every route: its stops and how many trips follow it."""
    return route_merge(snap.connections).select(F.array_join("stops", ">").alias("route"), F.size("stops").alias("n_stops"), "n_trips", "first_trip")


def routes_of_trips(snap: Snapshot) -> DataFrame:
    return trip_routes(snap.connections).select("trip_id", F.array_join("stops", ">").alias("route"))


def tile_features(snap: Snapshot, low: int, high: int) -> DataFrame:
    """(layer, zoom, x, y, feature, properties): each pair of stops in all tiles that the line between them crosses, each stop in its own. Tiles are not encoded here."""
    place = snap.stops.select("stop_id", "lon", "lat")
    n = F.pow(F.lit(2.0), "zoom")

    def at(p: str) -> list[Column]:
        """Place of a point in tiles."""
        rad = F.radians(f"{p}_lat")
        return [((F.col(f"{p}_lon") + 180.0) / 360.0 * n).alias(f"{p}x"), ((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n).alias(f"{p}y")]

    zooms = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("zoom")
    end = lambda stop, p: place.select(F.col("stop_id").alias(stop), F.col("lon").alias(f"{p}_lon"), F.col("lat").alias(f"{p}_lat"))
    pairs = edge_stats(snap).join(end("dep_stop", "a"), "dep_stop").join(end("arr_stop", "b"), "arr_stop").select("*", zooms)
    lines = pairs.select(F.lit("routes").alias("layer"), "zoom", F.concat("dep_stop", F.lit(">"), "arr_stop").alias("feature"), F.to_json(F.struct("n_operators", "n_route_types", "n_routes")).alias("properties"), *at("a"), *at("b"))
    span = lambda a, b: F.sequence(F.floor(F.least(a, b)), F.floor(F.greatest(a, b)))
    # In each column of tiles, the rows between where the line enters and where it leaves.
    lines = lines.withColumn("x", F.explode(span(F.col("ax"), F.col("bx"))))
    flat = F.col("ax") == F.col("bx")
    y = lambda edge: F.when(~flat, F.col("ay") + (edge - F.col("ax")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0)) * (F.col("by") - F.col("ay")))
    enters = F.coalesce(F.when(F.col("x") <= F.least("ax", "bx"), F.when(F.col("ax") <= F.col("bx"), F.col("ay")).otherwise(F.col("by"))).otherwise(y(F.col("x"))), F.col("ay"))
    leaves = F.coalesce(F.when(F.col("x") + 1 >= F.greatest("ax", "bx"), F.when(F.col("ax") <= F.col("bx"), F.col("by")).otherwise(F.col("ay"))).otherwise(y(F.col("x") + 1)), F.col("by"))
    crossed = lines.withColumn("y", F.explode(span(enters, leaves))).select("layer", "zoom", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "feature", "properties").distinct()
    own = stop_stats(snap).join(end("stop_id", "a"), "stop_id").select("*", zooms)
    points = own.select(F.lit("stops").alias("layer"), "zoom", F.col("stop_id").alias("feature"), F.to_json(F.struct("n_routes", "n_operators", "arrivals", "departures")).alias("properties"), *at("a"))
    return crossed.unionByName(points.select("layer", "zoom", F.floor("ax").cast("int").alias("x"), F.floor("ay").cast("int").alias("y"), "feature", "properties"))


def tile_manifest(snap: Snapshot, name: str, low: int, high: int) -> str:
    box = bounding_box(snap.stops).first()
    return json.dumps({"name": name, "minzoom": low, "maxzoom": high, "bounds": [box["min_lon"], box["min_lat"], box["max_lon"], box["max_lat"]], "vector_layers": [{"id": "routes"}, {"id": "stops"}]})


#: Map tags of GTFS route types (fixed values).
ROUTE_TYPES = {"0": "tram", "1": "subway", "2": "train", "3": "bus", "4": "ferry", "5": "tram", "6": "aerialway", "7": "funicular"}


def route_tag(route_type: Column) -> Column:
    out = F.lit("bus")
    for k, v in ROUTE_TYPES.items():
        out = F.when(route_type == k, v).otherwise(out)
    return out


def map_relations(snap: Snapshot) -> DataFrame:
    """(route, tag, pos, member): the relation of each route with its nodes and ways."""
    kinds = snap.trips.groupBy(F.col("attributes")["route"].alias("route")).agg(F.min(F.col("attributes")["route_type"]).alias("t"))
    return relation_members(snap).join(kinds, "route").select("route", route_tag(F.col("t")).alias("tag"), "pos", "member")


def map_nodes(snap: Snapshot) -> DataFrame:
    return snap.stops.select(F.concat(F.lit("node:"), "stop_id").alias("node"), "lon", "lat", F.coalesce(F.col("attributes")["name"], F.lit("")).alias("name"))


def map_ways(snap: Snapshot) -> DataFrame:
    return snap.connections.select(F.concat(F.lit("way:"), "dep_stop", F.lit(">"), "arr_stop").alias("way"), F.concat(F.lit("node:"), "dep_stop").alias("from_node"), F.concat(F.lit("node:"), "arr_stop").alias("to_node")).distinct()


def show_info(snap: Snapshot) -> DataFrame:
    """(global_id, key, value) of the snapshot's attributes."""
    rows = [(snap.global_id, k, v) for k, v in sorted(snap.meta.items())] or [(snap.global_id, None, None)]
    return snap.connections.sparkSession.createDataFrame(rows, "global_id string, key string, value string")


def as_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
