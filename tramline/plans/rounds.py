"""Journey planning by rounds of joins: each round is one vehicle more, for all queries at once.

A label of a stop is the earliest arrival and the earliest time from which a vehicle can be boarded (ready): an arrival by ride needs the
transfer time, one on foot does not. Rounds end when no label improves. State is written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import can_get_off, can_get_on, is_cancelled
from ..operators.filters import next_at
from ..operators.pareto import prune
from ..storage import stored

TRANSFER = 180


def in_window(connections: DataFrame, start: int, end: int) -> DataFrame:
    """What a scan of the window can use: departures in [start, end), not cancelled."""
    return connections.where((F.col("dep_time") >= start) & (F.col("dep_time") < end) & ~is_cancelled()).select("conn_id", "dep_stop", "arr_stop", "dep_time", "arr_time", "mode", "trip_id")


def _better(new: DataFrame, old: DataFrame, columns: tuple[str, str], sign: int) -> tuple[DataFrame, DataFrame, int]:
    """(all labels, those that improved, how many those are: counted while they are written)."""
    a, b = columns
    pick = F.min if sign == 1 else F.max
    both = old.withColumn("old", F.lit(1)).unionByName(new.withColumn("old", F.lit(0)))
    best = both.groupBy("query_id", "stop").agg(pick(a).alias(a), pick(b).alias(b), pick(F.when(F.col("old") == 1, F.col(a))).alias("a0"), pick(F.when(F.col("old") == 1, F.col(b))).alias("b0"))
    best = best.withColumn("improved", F.col("a0").isNull() | (F.col(a) != F.col("a0")) | F.col("b0").isNull() | (F.col(b) != F.col("b0")))
    seen = Observation()
    best = stored(best.drop("a0", "b0").observe(seen, F.count_if("improved").alias("n")), "labels")
    return best.drop("improved"), best.where("improved").drop("improved"), seen.get["n"]


def earliest_arrivals(connections: DataFrame, origins: DataFrame, start: int, end: int, transfer: int = TRANSFER, footpaths: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(query_id, stop, arrival, ready) of every stop reached from origins (query_id, stop) within the window, the origins included."""
    # Every round reads the window twice: it is written once, filtered.
    w = stored(in_window(connections, start, end), "window")
    on, off = w.where(can_get_on()), w.where(can_get_off())
    labels = origins.select("query_id", "stop", F.lit(start).cast("bigint").alias("arrival"), F.lit(start).cast("bigint").alias("ready"))
    if footpaths is not None:
        labels = labels.unionByName(_walked(labels, footpaths, end)).groupBy("query_id", "stop").agg(F.min("arrival").alias("arrival"), F.min("ready").alias("ready"))
    front, n = labels, 0
    while rounds is None or n < rounds:
        n += 1
        board = front.join(on, front["stop"] == on["dep_stop"]).where(F.col("dep_time") >= F.col("ready")).groupBy("query_id", "trip_id").agg(F.min("dep_time").alias("boarded"))
        ride = board.join(off, "trip_id").where(F.col("dep_time") >= F.col("boarded")).groupBy("query_id", F.col("arr_stop").alias("stop")).agg(F.min("arr_time").alias("arrival"))
        new = ride.withColumn("ready", F.col("arrival") + transfer)
        if footpaths is not None:
            new = new.unionByName(_walked(new, footpaths, end))
        labels, front, improved = _better(new, labels, ("arrival", "ready"), 1)
        if not improved:
            break
    return labels


def _walked(labels: DataFrame, footpaths: DataFrame, end: int) -> DataFrame:
    to = labels.join(footpaths, labels["stop"] == footpaths["from_stop"]).select("query_id", F.col("to_stop").alias("stop"), (F.col("arrival") + F.col("secs")).alias("arrival"))
    return to.where(F.col("arrival") <= end).withColumn("ready", F.col("arrival"))


def latest_departures(connections: DataFrame, targets: DataFrame, start: int, end: int, transfer: int = TRANSFER, footpaths: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(query_id, stop, departure, ready) of every stop from which targets (query_id, stop) are reached by the window's end: the mirror image."""
    w = stored(in_window(connections, start, end).where(F.col("arr_time") <= end), "window")
    on, off = w.where(can_get_on()), w.where(can_get_off())
    labels = targets.select("query_id", "stop", F.lit(end).cast("bigint").alias("departure"), F.lit(end).cast("bigint").alias("ready"))
    if footpaths is not None:
        labels = labels.unionByName(_walked_to(labels, footpaths, start)).groupBy("query_id", "stop").agg(F.max("departure").alias("departure"), F.max("ready").alias("ready"))
    front, n = labels, 0
    while rounds is None or n < rounds:
        n += 1
        leave = front.join(off, front["stop"] == off["arr_stop"]).where(F.col("arr_time") <= F.col("ready")).groupBy("query_id", "trip_id").agg(F.max("dep_time").alias("left"))
        ride = leave.join(on, "trip_id").where(F.col("dep_time") <= F.col("left")).groupBy("query_id", F.col("dep_stop").alias("stop")).agg(F.max("dep_time").alias("departure"))
        new = ride.withColumn("ready", F.col("departure") - transfer)
        if footpaths is not None:
            new = new.unionByName(_walked_to(new, footpaths, start))
        labels, front, improved = _better(new, labels, ("departure", "ready"), -1)
        if not improved:
            break
    return labels


def _walked_to(labels: DataFrame, footpaths: DataFrame, start: int) -> DataFrame:
    to = labels.join(footpaths, labels["stop"] == footpaths["to_stop"]).select("query_id", F.col("from_stop").alias("stop"), (F.col("departure") - F.col("secs")).alias("departure"))
    return to.where(F.col("departure") >= start).withColumn("ready", F.col("departure"))


def rides(connections: DataFrame, start: int, end: int) -> DataFrame:
    """(stop, dep, end_stop, end_arr): every way to board a trip and leave it within the window."""
    w = in_window(connections, start, end).where(F.col("arr_time") <= end)
    a = w.where(can_get_on()).select("trip_id", F.col("dep_stop").alias("stop"), F.col("dep_time").alias("dep"))
    b = w.where(can_get_off()).select("trip_id", F.col("arr_stop").alias("end_stop"), F.col("dep_time").alias("last"), F.col("arr_time").alias("end_arr"))
    return a.join(b, "trip_id").where(F.col("last") >= F.col("dep")).select("stop", "dep", "end_stop", "end_arr").distinct()


def profiles(connections: DataFrame, targets: list[str], start: int, end: int, transfer: int = TRANSFER, rounds: int | None = None) -> DataFrame:
    """(stop, dep, arr, vehicles): for every stop the journeys to the targets that none beats in departure, arrival and vehicles.

    A round adds a vehicle; rounds end when none adds a journey. Of the journeys that a ride can be put before, all of one number of vehicles
    and none beaten, the first that still can be caught arrives first: rides and departures meet in one as-of join, never in pairs.
    """
    own = stored(rides(connections, start, end), "rides")
    last = stored(prune(own.where(F.col("end_stop").isin(targets)).select("stop", "dep", F.col("end_arr").alias("arr"), F.lit(1).alias("vehicles")), most_vehicles=1), "profile")
    front, known = last, last
    # Journeys that start where they end are of no use.
    own = own.where(~F.col("stop").isin(targets))
    vehicles = 1
    while rounds is None or vehicles < rounds:
        asked = own.select(F.col("end_stop").alias("at"), (F.col("end_arr") + transfer).alias("t"), "stop", "dep")
        met = next_at(asked, front.select(F.col("stop").alias("at"), F.col("dep").alias("t"), "arr"), "at", "t", ["arr"])
        vehicles += 1
        new = met.where("arr IS NOT NULL").groupBy("stop", "dep").agg(F.min("arr").alias("arr")).withColumn("vehicles", F.lit(vehicles))
        merged = stored(prune(known.unionByName(new), most_vehicles=vehicles), "profile")
        front = merged.join(known, ["stop", "dep", "arr", "vehicles"], "left_anti")
        known = merged
        if front.isEmpty():
            break
    return known.where(~F.col("stop").isin(targets))
