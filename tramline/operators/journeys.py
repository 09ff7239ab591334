"""Algebra of journeys, kept as arrays of legs (kind, conn_id, trip_id, from_stop, to_stop, dep, arr)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LEG

RIDE, WALK, TRANSFER = "ride", "walk", "transfer"


def leg(kind: str | Column, conn: Column, trip: Column, start: Column, end: Column, dep: Column, arr: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), conn.alias("conn_id"), trip.alias("trip_id"), start.alias("from_stop"), end.alias("to_stop"), dep.cast("bigint").alias("dep"), arr.cast("bigint").alias("arr"))


def legs_array(*legs: Column) -> Column:
    return F.array(*legs).cast(f"array<{LEG}>")


def chain(legs: Column, new: Column) -> Column:
    return F.concat(legs, F.array(new))


def chain_backward(legs: Column, new: Column) -> Column:
    return F.concat(F.array(new), legs)


def chain_special(legs: Column, kind: str, to_stop: Column, secs: Column) -> Column:
    """A walk or transfer after the last leg; null if there is no time for one (secs null)."""
    last = F.element_at(legs, -1)
    none = F.lit(None).cast("string")
    return F.when(secs.isNotNull(), chain(legs, leg(kind, none, none, last["to_stop"], to_stop, last["arr"], last["arr"] + secs)))


def append(legs: Column, tail: Column) -> Column:
    return F.concat(legs, tail)


def reverse(legs: Column) -> Column:
    """The legs of a journey built from its end, in order of travel."""
    return F.reverse(legs)


def fold(legs: Column, zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """A metric of a journey as a fold over its legs."""
    return F.aggregate(legs, zero, step, finish)


def metric(legs: Column) -> Column:
    """Struct of vehicles, travel_time, walking_time: a ride counts as a vehicle where its trip differs from the leg before or that was no ride."""
    zero = F.struct(F.lit(0).alias("vehicles"), F.lit(0).cast("bigint").alias("travel_time"), F.lit(0.0).alias("walking_time"), F.lit(None).cast("string").alias("trip"), F.lit(None).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        rides = x["kind"] == RIDE
        fresh = rides & (acc["trip"].isNull() | (acc["trip"] != x["trip_id"]))
        wait = F.coalesce(F.abs(x["dep"] - acc["at"]), F.lit(0))
        took = F.abs(x["arr"] - x["dep"])
        return F.struct(
            (acc["vehicles"] + F.when(fresh, 1).otherwise(0)).alias("vehicles"), (acc["travel_time"] + took + wait).alias("travel_time"), (acc["walking_time"] + F.when(x["kind"] == WALK, took).otherwise(0)).cast("double").alias("walking_time"),
            F.when(rides, x["trip_id"]).alias("trip"), x["arr"].alias("at"),
        )

    return fold(legs, zero, step, lambda acc: F.struct(acc["vehicles"].alias("vehicles"), acc["travel_time"].alias("travel_time"), acc["walking_time"].alias("walking_time")))


def measure(journeys: DataFrame) -> DataFrame:
    """Departure, arrival and metric of each journey, computed from its legs."""
    m = metric(F.col("legs"))
    return journeys.withColumn("m", m).withColumns({"departure": departure(F.col("legs")), "arrival": arrival(F.col("legs")), "vehicles": F.col("m.vehicles"), "travel_time": F.col("m.travel_time"), "walking_time": F.col("m.walking_time")}).drop("m")


def departure(legs: Column) -> Column:
    return F.try_element_at(legs, F.lit(1))["dep"]


def arrival(legs: Column) -> Column:
    return F.try_element_at(legs, F.lit(-1))["arr"]


def last_trip_id(legs: Column) -> Column:
    return F.try_element_at(F.filter(legs, lambda x: x["kind"] == RIDE), F.lit(-1))["trip_id"]


def set_tag(journeys: DataFrame, tag: str) -> DataFrame:
    return journeys.withColumn("tag", F.lit(tag))


def has_loop(legs: Column) -> Column:
    """Whether a stop is visited twice, waiting at one apart."""
    moved = F.filter(legs, lambda x: x["from_stop"] != x["to_stop"])
    stops = F.concat(F.slice(F.transform(moved, lambda x: x["from_stop"]), 1, 1), F.transform(moved, lambda x: x["to_stop"]))
    return F.size(F.array_distinct(stops)) < F.size(stops)


def legs_of(journeys: DataFrame) -> DataFrame:
    """A row for each leg, root first: (query_id, journey_id, pos, leg columns)."""
    return journeys.select("query_id", "journey_id", F.posexplode("legs").alias("pos", "leg")).select("query_id", "journey_id", "pos", "leg.*")


def summarize(journeys: DataFrame) -> DataFrame:
    """One leg per vehicle or walk: rides in a row on one trip are one leg."""
    rows = legs_of(journeys)
    order = Window.partitionBy("query_id", "journey_id").orderBy("pos")
    same = (F.col("kind") == RIDE) & (F.lag("kind").over(order) == RIDE) & (F.col("trip_id") == F.lag("trip_id").over(order))
    rows = rows.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    out = rows.groupBy("query_id", "journey_id", "island").agg(
        F.min_by("kind", "pos").alias("kind"), F.min_by("conn_id", "pos").alias("conn_id"), F.min_by("trip_id", "pos").alias("trip_id"), F.min_by("from_stop", "pos").alias("from_stop"), F.max_by("to_stop", "pos").alias("to_stop"), F.min("dep").alias("dep"), F.max("arr").alias("arr")
    )
    return out.withColumnRenamed("island", "pos")


def count_leaves(journeys: DataFrame) -> DataFrame:
    """How many equally good alternatives each journey of a query stands for: those alike in departure, arrival and vehicles."""
    return journeys.groupBy("query_id", "departure", "arrival", "vehicles").agg(F.count("*").alias("leaves"))


def to_text(journeys: DataFrame) -> DataFrame:
    """(query_id, journey_id, itinerary): one line a leg."""
    line = lambda x: F.format_string("%s %s %s -> %s %s", F.date_format(F.timestamp_seconds(x["dep"]), "HH:mm"), F.coalesce(x["trip_id"], x["kind"]), x["from_stop"], F.date_format(F.timestamp_seconds(x["arr"]), "HH:mm"), x["to_stop"])
    return journeys.select("query_id", "journey_id", F.array_join(F.transform("legs", line), "\n").alias("itinerary"))


def to_geojson(journeys: DataFrame, stops: DataFrame) -> DataFrame:
    """(query_id, journey_id, geojson): a point for each leg that is no ride, and one line through all places."""
    rows = legs_of(journeys)
    first = rows.where("pos = 0").select("query_id", "journey_id", F.lit(-1).alias("pos"), F.lit(RIDE).alias("kind"), F.col("from_stop").alias("stop_id"))
    places = first.unionByName(rows.select("query_id", "journey_id", "pos", "kind", F.col("to_stop").alias("stop_id"))).join(stops.select("stop_id", "lon", "lat"), "stop_id")
    own = places.groupBy("query_id", "journey_id").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "stop_id", "lon", "lat"))).alias("p"))
    coordinates = lambda x: F.array(x["lon"], x["lat"])
    feature = lambda kind, c, props: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry"), props.alias("properties")))
    points = F.transform(F.filter("p", lambda x: x["kind"] != RIDE), lambda x: feature("Point", coordinates(x), F.struct(x["stop_id"].alias("stop_id"), x["kind"].alias("kind"))))
    line = feature("LineString", F.transform("p", coordinates), F.struct(F.size("p").alias("stops")))
    return own.select("query_id", "journey_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.concat(points, F.array(line)), ","), F.lit("]}")).alias("geojson"))
