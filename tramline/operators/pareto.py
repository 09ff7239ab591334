"""Frontiers of journeys: departure as late, arrival as early, vehicles as few as can be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(F.desc("dep"), F.asc("arr"), F.asc("vehicles")).rowsBetween(Window.unboundedPreceding, -1)


def prune(rows: DataFrame, keys: Sequence[str] = ("stop",), most_vehicles: int | None = None) -> DataFrame:
    """The distinct (keys, dep, arr, vehicles) that none dominates. most_vehicles: the greatest number there is; without it rows are asked.

    Sorted by departure falling, what can dominate a row stands before it: it does if the least arrival so far, among rows of no more vehicles,
    is no later. One running minimum for each number of vehicles finds it, so rows are never compared in pairs.
    """
    distinct = rows.select(*keys, "dep", "arr", "vehicles").distinct()
    if most_vehicles is None:
        most_vehicles = max(1, distinct.agg(F.max("vehicles")).first()[0] or 1)
    before = _before(keys)
    least = F.array(*[F.min(F.when(F.col("vehicles") <= v, F.col("arr"))).over(before) for v in range(1, most_vehicles + 1)])
    marked = distinct.withColumn("least", F.get(least, F.least(F.col("vehicles"), F.lit(most_vehicles)) - 1))
    return marked.where(F.col("least").isNull() | (F.col("least") > F.col("arr"))).drop("least")


def add_to_frontier(frontier: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("stop",)) -> DataFrame:
    columns = [*keys, "dep", "arr", "vehicles"]
    return prune(frontier.select(*columns).unionByName(candidates.select(*columns)), keys)


combine = add_to_frontier


def on_frontier(frontier: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("stop",)) -> DataFrame:
    """candidates with on_frontier: whether the frontier would take them as they are."""
    kept = add_to_frontier(frontier, candidates, keys).withColumn("on_frontier", F.lit(True))
    return candidates.join(kept, [*keys, "dep", "arr", "vehicles"], "left").withColumn("on_frontier", F.coalesce("on_frontier", F.lit(False)))


def guess_prune(partial: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Partial journeys (stop, dep, arr, vehicles) that can still lead to one of use: a vehicle that left the start at now and stood at
    once where they begin would not be beaten by a journey found from there (dep, arr, vehicles) that leaves after now.
    """
    later = found.where(F.col("dep") > now).select(F.lit(0).alias("k"), F.lit(now).cast("bigint").alias("dep"), "arr", "vehicles")
    best = later.groupBy("vehicles").agg(F.min("arr").alias("least"))
    ahead = best.agg(F.collect_list(F.struct("vehicles", "least")).alias("ahead"))
    # One row: the least arrival for each number of vehicles.
    beaten = F.exists("ahead", lambda x: (x["vehicles"] <= F.col("vehicles")) & (x["least"] <= F.col("arr")))
    return partial.join(F.broadcast(ahead)).where(~beaten).select(*partial.columns)


def extend_backwards(rides: DataFrame, frontier: DataFrame, transfer: int = 180) -> DataFrame:
    """Rides (trip_id, stop, dep, end_stop, end_arr) put before the journeys of a frontier that leave end_stop after the transfer, one vehicle more.

    Of the journeys that can still be caught only the earliest arrival for each number of vehicles matters.
    """
    later = frontier.select(F.col("stop").alias("end_stop"), F.col("dep").alias("next_dep"), "arr", "vehicles")
    met = rides.join(later, "end_stop").where(F.col("next_dep") >= F.col("end_arr") + transfer)
    return met.groupBy("stop", "dep", F.col("vehicles") + 1).agg(F.min("arr").alias("arr")).withColumnRenamed("(vehicles + 1)", "vehicles").select("stop", "dep", "arr", "vehicles")


def compare(vehicles1: Column, travel1: Column, vehicles2: Column, travel2: Column) -> Column:
    """-1, 0 or 1 if the first is better, equal or worse in vehicles and travel time; null if neither."""
    better = (vehicles1 <= vehicles2) & (travel1 <= travel2)
    worse = (vehicles1 >= vehicles2) & (travel1 >= travel2)
    return F.when(better & worse, 0).when(better, -1).when(worse, 1)


FAMILY = ("query_id", "departure", "arrival", "from_stop", "to_stop", "vehicles", "travel_time")


def _with_ends(journeys: DataFrame) -> DataFrame:
    return journeys.withColumns({"from_stop": F.element_at("legs", 1)["from_stop"], "to_stop": F.element_at("legs", -1)["to_stop"]})


def prune_families(journeys: DataFrame, *larger: Column) -> DataFrame:
    """Of journeys alike in ends, times and metric the one the comparer ranks highest (by default by walking time, then id)."""
    order = Window.partitionBy(*FAMILY).orderBy(*(larger or (F.desc("walking_time"), F.desc("journey_id"))))
    return _with_ends(journeys).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "from_stop", "to_stop")


def partition_families(journeys: DataFrame) -> DataFrame:
    """Per family its key and how many journeys it holds, with the least id."""
    return _with_ends(journeys).groupBy(*FAMILY).agg(F.count("*").alias("leaves"), F.min("journey_id").alias("first_journey"))
