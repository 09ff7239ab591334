"""Filters, lookups and modifiers of snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Snapshot, all_of, is_cancelled


class EmptyResult(ValueError):
    """A filter left no connections."""


class UnknownId(KeyError):
    """An id that no row has."""


def used_stops(stops: DataFrame, connections: DataFrame) -> DataFrame:
    ends = connections.select(F.explode(F.array("dep_stop", "arr_stop")).alias("stop_id"))
    return stops.join(ends, "stop_id", "left_semi")


def used_trips(trips: DataFrame, connections: DataFrame) -> DataFrame:
    return trips.join(connections.select("trip_id"), "trip_id", "left_semi")


def remove_unused(snap: Snapshot) -> Snapshot:
    """Only the stops and trips that connections refer to."""
    return snap.with_tables(stops=used_stops(snap.stops, snap.connections), trips=used_trips(snap.trips, snap.connections))


def copy(
    snap: Snapshot,
    keep_stop: Column | None = None,
    keep_trip: Column | None = None,
    keep_connection: Column | None = None,
    modify_stop: Callable[[DataFrame], DataFrame] | None = None,
    modify_trip: Callable[[DataFrame], DataFrame] | None = None,
    modify_connection: Callable[[DataFrame], DataFrame] | None = None,
    allow_empty: bool = True,
) -> Snapshot:
    """A filtered and changed copy: connections stay whose ends and trip stay; then only what they refer to."""
    stops = snap.stops if keep_stop is None else snap.stops.where(keep_stop)
    trips = snap.trips if keep_trip is None else snap.trips.where(keep_trip)
    connections = snap.connections if keep_connection is None else snap.connections.where(keep_connection)
    if keep_stop is not None:
        for end in ("dep_stop", "arr_stop"):
            connections = connections.join(stops.select(F.col("stop_id").alias(end)), end, "left_semi").select(*snap.connections.columns)
    if keep_trip is not None:
        connections = connections.join(trips.select("trip_id"), "trip_id", "left_semi").select(*snap.connections.columns)
    if not allow_empty and connections.isEmpty():
        raise EmptyResult("no connections are left")
    out = remove_unused(snap.with_tables(stops=stops, trips=trips, connections=connections))
    return out.with_tables(
        stops=modify_stop(out.stops) if modify_stop else out.stops, trips=modify_trip(out.trips) if modify_trip else out.trips, connections=modify_connection(out.connections) if modify_connection else out.connections
    )


def select_time(snap: Snapshot, start: int, end: int, allow_empty: bool = True) -> Snapshot:
    """Connections with start <= departure < end."""
    return copy(snap, keep_connection=(F.col("dep_time") >= start) & (F.col("dep_time") < end), allow_empty=allow_empty)


def select_bounding_box(snap: Snapshot, west: float, south: float, east: float, north: float, allow_empty: bool = True) -> Snapshot:
    return copy(snap, keep_stop=F.col("lat").between(south, north) & F.col("lon").between(west, east), allow_empty=allow_empty)


def select_stops(snap: Snapshot, ids: str | Sequence[str], allow_empty: bool = True) -> Snapshot:
    """Connections that touch any of the stops (ids separated by ';'), at either end."""
    wanted = ids.split(";") if isinstance(ids, str) else list(ids)
    find_stops(snap.stops, wanted)
    return copy(snap, keep_connection=F.col("dep_stop").isin(wanted) | F.col("arr_stop").isin(wanted), allow_empty=allow_empty)


def select_trip(snap: Snapshot, trip_id: str, allow_empty: bool = True) -> Snapshot:
    return copy(snap, keep_connection=F.col("trip_id") == trip_id, allow_empty=allow_empty)


def not_cancelled() -> Column:
    return ~is_cancelled()


def filter_and(*conditions: Column | None) -> Column | None:
    return all_of(*conditions)


def isochrone_filter(connections: DataFrame, isochrone: DataFrame, backward: bool = False) -> DataFrame:
    """Connections that can be of use given what is reachable.

    Forward, isochrone is (stop, arrival): the departure stop is reached by the departure. Backward it is (stop, departure): from the arrival stop
    the target is still reached.
    """
    end, time, bound = ("arr_stop", "arr_time", "departure") if backward else ("dep_stop", "dep_time", "arrival")
    # One row a stop, so that a connection is kept once.
    best = isochrone.groupBy("stop").agg((F.max if backward else F.min)(bound).alias("bound"))
    fits = F.col("bound") >= F.col(time) if backward else F.col("bound") <= F.col(time)
    return connections.join(best, connections[end] == best["stop"]).where(fits).drop("stop", "bound")


def isochrone_filter_with_exceptions(connections: DataFrame, isochrone: DataFrame, stops: Sequence[str], backward: bool = False) -> DataFrame:
    """As isochrone_filter, but connections that touch one of the given stops pass anyway."""
    listed = F.col("dep_stop").isin(list(stops)) | F.col("arr_stop").isin(list(stops))
    return isochrone_filter(connections.where(~listed), isochrone, backward).unionByName(connections.where(listed))


def max_transfers(most: int = 3) -> Column:
    """Journeys of one vehicle or more with at most so many transfers."""
    return (F.col("vehicles") >= 1) & (F.col("vehicles") - 1 <= most)


def remove_delays(connections: DataFrame) -> DataFrame:
    """Times as planned: less the delays kept in the attributes."""
    delay = lambda k: F.coalesce(F.col("attributes")[k].cast("bigint"), F.lit(0))
    planned = connections.withColumns({"dep_time": F.col("dep_time") - delay("departureDelay"), "arr_time": F.col("arr_time") - delay("arrivalDelay")})
    return planned.withColumn("travel_time", (F.col("arr_time") - F.col("dep_time")).cast("int"))


def lookup(rows: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    return rows.where(F.col(key).isin(list(ids)))


def find_stops(stops: DataFrame, ids: Sequence[str], message: str = "no stop has the id {}") -> DataFrame:
    """The stops of the ids in their order, with pos. The first unknown id is an error."""
    known = {r["stop_id"] for r in lookup(stops, "stop_id", ids).select("stop_id").distinct().collect()}
    for i in ids:
        if i not in known:
            raise UnknownId(message.format(i))
    return get_all(stops, "stop_id", ids)


def get_all(rows: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """A row for each id, in order (pos); ids that no row has are left out."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {key} string")
    return wanted.join(rows, key).orderBy("pos")


def scan_from(connections: DataFrame, time: int, backward: bool = False) -> DataFrame:
    """Connections in order of departure from a time on, or backward from it."""
    if backward:
        return connections.where(F.col("dep_time") <= time).orderBy(F.desc("dep_time"), F.desc("conn_id"))
    return connections.where(F.col("dep_time") >= time).orderBy("dep_time", "conn_id")


#: Seconds of a slot of time within which rows of a stop meet in one task.
SLOT = 3600


def next_at(left: DataFrame, right: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the first row of right of its key at its time or later (null if there is none): an as-of join forward.

    Rows of a key meet by slots of time, so that a hub is many tasks; what follows in later slots comes from a small table of each slot's first row.
    Of rows of right alike in key and time the least in columns counts.
    """
    slot = F.floor(F.col(time) / SLOT)
    first = right.groupBy(key, time).agg(F.min(F.struct(*columns)).alias("r")).withColumn("slot", slot)
    own = left.withColumns({"slot": slot, "own": F.struct(*left.columns)})
    order = Window.partitionBy(key, "slot").orderBy(F.desc(time), F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = own.select(key, time, "slot", "own", F.lit(None).cast(first.schema["r"].dataType).alias("r")).unionByName(first.select(key, time, "slot", F.lit(None).cast(own.schema["own"].dataType).alias("own"), "r"))
    inside = both.withColumn("near", F.last("r", ignorenulls=True).over(order)).where("own IS NOT NULL").select(key, "slot", "own", "near")
    # The first row of the next slot that has any, for every slot asked for.
    heads = first.groupBy(key, "slot").agg(F.min_by("r", time).alias("head")).withColumn("asks", F.lit(False))
    asked = own.select(key, "slot").distinct().select(key, "slot", F.lit(None).cast(first.schema["r"].dataType).alias("head"), F.lit(True).alias("asks"))
    slots = heads.unionByName(asked).groupBy(key, "slot").agg(F.max("head").alias("head"), F.max("asks").alias("asks"))
    ahead = Window.partitionBy(key).orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    slots = slots.withColumn("far", F.first("head", ignorenulls=True).over(ahead)).where("asks").select(key, "slot", "far")
    found = inside.join(slots, [key, "slot"], "left").withColumn("r", F.coalesce("near", "far"))
    return found.select("own.*", *[F.col("r")[c].alias(c) for c in columns])


def next_departures(arrivals: DataFrame, connections: DataFrame, transfer: int = 180) -> DataFrame:
    """For each (stop, arrival) the first connection that leaves there after the transfer time (ties by id), with conn_id and dep_time."""
    asked = arrivals.select("stop", (F.col("arrival") + transfer).alias("t"), "arrival")
    leaves = connections.select(F.col("dep_stop").alias("stop"), F.col("dep_time").alias("t"), "conn_id", "dep_time")
    return next_at(asked, leaves, "stop", "t", ["conn_id", "dep_time"]).select("stop", "arrival", "conn_id", "dep_time")


def continuations(connections: DataFrame) -> DataFrame:
    """Each connection with the next one of its trip (null at the trip's end)."""
    order = Window.partitionBy("trip_id").orderBy("dep_time", "conn_id")
    return connections.withColumns({"next_conn": F.lead("conn_id").over(order), "next_dep": F.lead("dep_time").over(order)})
