"""Validation of trips: each connection against the one before it on its trip. The first of a trip is not checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance_m
from ..model import Snapshot

#: Speeds in km/h from which a connection counts as fast, by distance in metres below which they hold, and the fastest train (fixed values).
FAST = ((10_000, 100), (50_000, 150), (100_000, 200))
RECORD = 574


def with_previous(connections: DataFrame) -> DataFrame:
    """Each connection with the arrival stop and time of the one before it on its trip."""
    order = Window.partitionBy("trip_id").orderBy("dep_time", "conn_id")
    return connections.withColumns({"prev_conn": F.lag("conn_id").over(order), "prev_stop": F.lag("arr_stop").over(order), "prev_arr": F.lag("arr_time").over(order)})


def validate(snap: Snapshot, relax: bool = False) -> DataFrame:
    """(conn_id, type, is_hard_error, message) for each fault."""
    place = snap.stops.select("stop_id", "lon", "lat")
    at = lambda end: place.select(F.col("stop_id").alias(f"{end}_stop"), F.col("lon").alias(f"{end}_lon"), F.col("lat").alias(f"{end}_lat"))
    rows = with_previous(snap.connections).where("prev_conn IS NOT NULL").join(at("dep"), "dep_stop", "left").join(at("arr"), "arr_stop", "left")
    rows = rows.withColumn("dist", distance_m(F.col("dep_lon"), F.col("dep_lat"), F.col("arr_lon"), F.col("arr_lat")))
    return rows.select("conn_id", F.explode(F.array_compact(F.array(*faults(relax)))).alias("f")).select("conn_id", "f.type", "f.is_hard_error", "f.message")


def faults(relax: bool) -> list[Column]:
    dist, travel = F.col("dist"), F.col("arr_time") - F.col("dep_time")
    speed = dist / travel * 3.6
    near = dist < 10_000
    still = F.col("dep_stop") == F.col("arr_stop")
    at_once = travel == 0
    close = dist < (1 if relax else 50)

    def fault(when: Column, kind: str, hard: bool, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(hard).alias("is_hard_error"), text.alias("message")))

    teleports = at_once & (~near if relax else F.lit(True))
    moves = ~at_once & ~close
    limit = F.lit(None).cast("int")
    for metres, kmh in reversed(FAST):
        limit = F.when(dist < metres, kmh).otherwise(limit)
    fast = (speed > limit) & ~(near if relax else F.lit(False))
    said = F.format_string("%.0f m in %d s", dist, travel)
    return [
        fault(F.col("prev_stop") != F.col("dep_stop"), "jump", True, F.concat(F.lit("arrived at "), "prev_stop", F.lit(", leaves from "), "dep_stop")),
        fault(still, "stall", True, F.concat(F.lit("stays at "), "dep_stop")),
        fault(F.col("prev_arr") > F.col("dep_time"), "timetravel", True, F.format_string("arrived at %d, leaves at %d", F.col("prev_arr"), F.col("dep_time"))),
        fault(~still & teleports, "teleportation", False, said),
        fault(~still & ~at_once & close, "closeby", True, said),
        fault(~still & moves & (travel < 0), "reverse", True, said),
        fault(~still & moves & (travel > 0) & (speed <= 1) & ~(near if relax else F.lit(False)), "slow", False, said),
        fault(~still & moves & (travel > 0) & fast, "fast", False, said),
        fault(~still & moves & (travel > 0) & (speed >= RECORD), "world-record", True, said),
    ]


def cutoff(messages: DataFrame, n: int = 10) -> DataFrame:
    """The first n messages of each type by connection."""
    order = Window.partitionBy("type").orderBy("conn_id", "message")
    return messages.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


class NotSorted(ValueError):
    """A scan that is not in order of departure."""


def check_order(connections: DataFrame, seq: str) -> None:
    """Raises NotSorted if departures fall along seq. Rows are compared with the one before in their own range and ranges with each other."""
    ranged = connections.select(F.col(seq).alias("s"), "dep_time").repartitionByRange("s").sortWithinPartitions("s")
    part = F.spark_partition_id().alias("p")
    rows = ranged.select(part, "s", "dep_time")
    inner = Window.partitionBy("p").orderBy("s")
    falls = rows.withColumn("before", F.lag("dep_time").over(inner)).where("before > dep_time")
    ends = rows.groupBy("p").agg(F.min("s").alias("s"), F.min_by("dep_time", "s").alias("first"), F.max_by("dep_time", "s").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.orderBy("s"))).where("before > first")
    if not falls.isEmpty() or not between.isEmpty():
        raise NotSorted("the scan is not in order of departure")
