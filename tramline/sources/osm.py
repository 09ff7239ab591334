"""Route relations of a map extract to stops and runs; and map URLs as stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import pairs_in_range
from ..functions.parsers import duration_seconds, map_place, packed_place
from ..model import Snapshot

#: Metres within which a platform belongs to a stop position (fixed value).
NEAR = 25.0
TAGS = "array<struct<_k:string,_v:string>>"
RELATION = f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag {TAGS}"
NODE = f"_id long, _lat double, _lon double, tag {TAGS}"


class BadRelation(ValueError):
    """A relation that is no route, has no duration, or whose platform is not a node."""


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(relations, nodes) of a map file."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return read("relation", RELATION), read("node", NODE)


def _tags(column: str = "tag") -> Column:
    return F.map_from_entries(F.coalesce(F.col(column), F.expr(f"cast(array() as {TAGS})")))


def routes(relations: DataFrame) -> DataFrame:
    """(route_id, name, round_trip, duration, interval, members): interval defaults to duration; no duration is an error."""
    r = relations.withColumn("tags", _tags()).where(F.col("tags")["type"] == "route")
    out = r.select(F.col("_id").alias("route_id"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), (F.coalesce(F.col("tags")["roundtrip"], F.lit("no")) == "yes").alias("round_trip"), duration_seconds(F.col("tags")["duration"]).alias("duration"), duration_seconds(F.col("tags")["interval"]).alias("interval"), F.col("member").alias("members"))
    return out.withColumn("interval", F.coalesce("interval", "duration"))


def check_routes(found: DataFrame) -> None:
    """Raises BadRelation for routes without a duration, and for platforms that are ways or relations."""
    bad = found.where("duration IS NULL OR duration <= 0").select("route_id").first()
    if bad:
        raise BadRelation(f"relation {bad['route_id']} has no duration")
    bad = found.where(F.exists("members", lambda m: m["_role"].startswith("platform") & (m["_type"] != "node"))).select("route_id").first()
    if bad:
        raise BadRelation(f"relation {bad['route_id']} has a platform that is not a node")


def stop_positions(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route_id, pos, node, lon, lat, name): nodes of role stop, then platforms that have no stop within 25 m, in order of the members."""
    m = found.select("route_id", F.posexplode("members").alias("pos", "m")).select("route_id", "pos", F.col("m._ref").alias("node"), F.col("m._role").alias("role"), F.col("m._type").alias("type")).where("type = 'node'")
    own = nodes.select(F.col("_id").alias("node"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags().alias("tags"))
    m = m.join(own, "node")
    stop = F.col("role").startswith("stop")
    platform = F.col("role").startswith("platform") | (F.coalesce(F.col("tags")["public_transport"], F.lit("")) == "platform")
    named = F.coalesce(F.col("tags")["name"], F.lit("")).alias("name")
    stops = m.where(stop).select("route_id", "pos", "node", "lon", "lat", named)
    others = m.where(~stop & platform).select("route_id", "pos", "node", "lon", "lat", named)
    key = F.concat_ws("/", "route_id", "node")
    near = pairs_in_range(others.withColumn("stop_id", key), stops.withColumn("stop_id", key), NEAR)
    same = F.split("from_stop", "/")[0] == F.split("to_stop", "/")[0]
    alone = others.withColumn("from_stop", key).join(near.where(same), "from_stop", "left_anti").drop("from_stop")
    rows = stops.withColumn("later", F.lit(0)).unionByName(alone.withColumn("later", F.lit(1)))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("route_id").orderBy("later", "pos")) - 1).drop("later")


def runs(found: DataFrame, positions: DataFrame, start: int, end: int) -> DataFrame:
    """Connections of all runs: from start, every interval until end. A hop takes duration / stops; see vehicle for the trip.

    A round trip returns to its first stop, and its vehicles follow each other; on a line the first hop is to get on, the last to get off.
    """
    stop = lambda c: F.concat(F.lit("https://www.openstreetmap.org/node/"), c)
    n = positions.groupBy("route_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("route_id").orderBy("pos")
    ring = F.first("node").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hop = positions.join(n, "route_id").join(found.select("route_id", "round_trip", "duration", "interval"), "route_id")
    hop = hop.withColumn("next", F.coalesce(F.lead("node").over(order), F.when(F.col("round_trip"), ring))).where(F.col("next").isNotNull() & (F.col("next") != F.col("node")))
    hop = hop.withColumn("hops", F.when(F.col("round_trip"), F.col("n")).otherwise(F.col("n") - 1)).withColumn("took", F.floor(F.col("duration") / F.col("n")))
    each = hop.withColumn("at", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(end).cast("bigint"), F.col("interval"))))
    run = F.floor((F.col("at") - start) / F.col("interval"))
    vehicles = F.ceil(F.col("duration") / F.col("interval"))
    vehicle = F.when(F.col("round_trip"), run % vehicles).otherwise(run)
    base = F.concat(F.lit("https://www.openstreetmap.org/relation/"), "route_id")
    mode = F.when(F.col("round_trip") | (F.col("hops") == 1), 0).when(F.col("pos") == 0, 1).when(F.col("pos") == F.col("hops") - 1, 2).otherwise(0)
    dep = F.col("at") + F.col("pos") * F.col("took")
    return each.select(
        F.concat(base, F.lit("/"), "at", F.lit("/"), "pos").alias("conn_id"), stop(F.col("node")).alias("dep_stop"), stop(F.col("next")).alias("arr_stop"), dep.cast("bigint").alias("dep_time"), F.col("took").cast("int").alias("travel_time"), (dep + F.col("took")).cast("bigint").alias("arr_time"),
        mode.cast("smallint").alias("mode"), F.concat(base, F.lit("/vehicle/"), vehicle).alias("trip_id"), F.expr("cast(map() as map<string,string>)").alias("attributes"),
    )


def load_route(spark: SparkSession, path: str, start: int, end: int) -> Snapshot:
    relations, nodes = read_xml(spark, path)
    found = routes(relations)
    check_routes(found)
    places = stop_positions(found, nodes)
    connections = runs(found, places, start, end)
    stops = places.select(F.concat(F.lit("https://www.openstreetmap.org/node/"), "node").alias("stop_id"), "lon", "lat", F.create_map(F.lit("name"), "name").alias("attributes")).dropDuplicates(["stop_id"])
    trips = connections.select("trip_id").distinct().select("trip_id", F.lit(None).cast("string").alias("operator_id"), F.expr("cast(map() as map<string,string>)").alias("attributes"))
    operators = spark.createDataFrame([], "operator_id string, attributes map<string,string>")
    return Snapshot(operators, stops, trips, connections, path)


def floating_stops(urls: DataFrame, column: str = "url") -> DataFrame:
    """Stops at the places of map URLs; texts that are none are left out. packed names the place as one number."""
    lon, lat = map_place(F.col(column))
    rows = urls.select(F.col(column).alias("stop_id"), lon.alias("lon"), lat.alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    return rows.select("stop_id", "lon", "lat", F.expr("cast(map() as map<string,string>)").alias("attributes"), packed_place(F.col("lon"), F.col("lat")).alias("packed")).dropDuplicates(["stop_id"])


def with_floating_stops(snap: Snapshot, urls: DataFrame, column: str = "url") -> Snapshot:
    return snap.with_tables(stops=snap.stops.unionByName(floating_stops(urls, column).drop("packed")))
