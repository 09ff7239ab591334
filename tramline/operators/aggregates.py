"""Aggregations over timetables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Snapshot


def trip_routes(connections: DataFrame) -> DataFrame:
    """(trip_id, stops): the first departure stop of a trip, then every arrival stop in order of time."""
    hop = F.struct("dep_time", "conn_id", "dep_stop", "arr_stop")
    own = connections.groupBy("trip_id").agg(F.sort_array(F.collect_list(hop)).alias("hops"))
    return own.select("trip_id", F.concat(F.slice(F.transform("hops", lambda h: h["dep_stop"]), 1, 1), F.transform("hops", lambda h: h["arr_stop"])).alias("stops"))


def route_merge(connections: DataFrame) -> DataFrame:
    """Trips that share an ordered stop sequence: (stops, n_trips, first_trip). Trips are counted per route, not gathered."""
    return trip_routes(connections).groupBy("stops").agg(F.count("*").alias("n_trips"), F.min("trip_id").alias("first_trip"))


def edges(snap: Snapshot) -> DataFrame:
    """Connections with their trip's operator, route and route type."""
    trips = snap.trips.select("trip_id", "operator_id", F.col("attributes")["route"].alias("route"), F.col("attributes")["route_type"].alias("route_type"))
    return snap.connections.select("trip_id", "dep_stop", "arr_stop").join(trips, "trip_id")


def edge_stats(snap: Snapshot) -> DataFrame:
    """Per pair of stops the distinct operators, route types and routes."""
    e = edges(snap).select("dep_stop", "arr_stop", "operator_id", "route_type", "route").distinct()
    return e.groupBy("dep_stop", "arr_stop").agg(F.countDistinct("operator_id").alias("n_operators"), F.countDistinct("route_type").alias("n_route_types"), F.countDistinct("route").alias("n_routes"))


def stop_stats(snap: Snapshot) -> DataFrame:
    """Per stop: routes, operators, arrivals, departures, movements; and route_departures, route_arrivals, which count a route once for each edge."""
    all_ = edges(snap).groupBy("dep_stop", "arr_stop", "route", "operator_id").agg(F.count("*").alias("n"))
    ends = all_.withColumn("end", F.explode(F.array(F.struct(F.col("dep_stop").alias("stop_id"), F.lit(1).alias("departs")), F.struct(F.col("arr_stop").alias("stop_id"), F.lit(0).alias("departs")))))
    e = ends.select("end.*", "route", "operator_id", "dep_stop", "arr_stop", "n")
    one = F.struct("dep_stop", "arr_stop", "route")
    out = e.groupBy("stop_id").agg(
        F.countDistinct("route").alias("n_routes"), F.countDistinct("operator_id").alias("n_operators"), F.sum(F.col("n") * (1 - F.col("departs"))).alias("arrivals"), F.sum(F.col("n") * F.col("departs")).alias("departures"),
        F.countDistinct(F.when(F.col("departs") == 1, one)).alias("route_departures"), F.countDistinct(F.when(F.col("departs") == 0, one)).alias("route_arrivals"),
    )
    return out.withColumn("movements", F.col("arrivals") + F.col("departures"))


def date_range(connections: DataFrame) -> DataFrame:
    return connections.agg(F.min("dep_time").alias("earliest"), F.max("dep_time").alias("latest"))


def counts(snap: Snapshot) -> DataFrame:
    """(name, n): the rows of each table."""
    out = None
    for name in ("operators", "stops", "trips", "connections"):
        one = getattr(snap, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def relation_members(snap: Snapshot) -> DataFrame:
    """Per route its members without repeats, in order of first sight: the stops, and the ways between pairs of stops."""
    trips = snap.trips.select("trip_id", F.col("attributes")["route"].alias("route"))
    hops = snap.connections.select("trip_id", "dep_stop", "arr_stop", "dep_time", "conn_id").join(trips, "trip_id")
    member = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.concat(F.lit("node:"), "dep_stop").alias("member")), F.struct(F.lit(1).alias("at"), F.concat(F.lit("way:"), "dep_stop", F.lit(">"), "arr_stop").alias("member")), F.struct(F.lit(2).alias("at"), F.concat(F.lit("node:"), "arr_stop").alias("member"))))
    seen = hops.select("route", "dep_time", "conn_id", member.alias("m")).groupBy("route", "m.member").agg(F.min(F.struct("dep_time", "conn_id", "m.at")).alias("first"))
    return seen.select("route", "member", F.row_number().over(Window.partitionBy("route").orderBy("first", "member")).alias("pos"))


def attribute_keys(rows: DataFrame) -> DataFrame:
    """The distinct keys of the attributes, in order."""
    return rows.select(F.explode(F.map_keys("attributes")).alias("key")).distinct().orderBy("key")


def headsign_coverage(trips: DataFrame) -> DataFrame:
    found = F.col("attributes")["headsign"].isNotNull()
    return trips.agg(F.count_if(found).alias("found"), F.count_if(~found).alias("failed"), F.count("*").alias("total"))


def delayed_count(connections: DataFrame) -> DataFrame:
    return connections.agg(F.count_if(F.col("attributes")["departureDelay"].cast("int") > 0).alias("delayed"))


def validation_histogram(messages: DataFrame) -> DataFrame:
    return messages.groupBy("type").agg(F.count("*").alias("n"), F.bool_or("is_hard_error").alias("hard"))


def shell_state(snap: Snapshot) -> DataFrame:
    """(name, n, earliest, latest) of the tables; times for connections only."""
    times = date_range(snap.connections).select(F.lit("connections").alias("name"), "earliest", "latest")
    return counts(snap).join(times, "name", "left")
