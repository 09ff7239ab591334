"""A timetable derived from the test tables: nations are stops, a user's day is a trip, two events in a row are a connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import Snapshot

#: Travel times over this are no connection (16 bits).
MOST_TRAVEL = 65535


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("stop/"), n).alias("stop_id"), (3.0 + (n % 5) * 0.004).alias("lon"), (51.0 + F.floor(n / 5) * 0.003).alias("lat"), F.create_map(F.lit("name"), F.col("n_name")).alias("attributes")
    )


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of events in a row of a user and day, unfiltered."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    visits = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", t.alias("t")).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("k", (F.col("event_id") * 7 + F.col("user_id")) % 25)
    order = Window.partitionBy("user_id", "day").orderBy("t", "event_id")
    return visits.select("event_id", "user_id", "event_type", "day", F.col("t").alias("dep_time"), F.col("k").alias("dep_k"), F.lead("t").over(order).alias("arr_time"), F.lead("k").over(order).alias("arr_k"))


def raw_connections(hops: DataFrame) -> DataFrame:
    """Hops in the shape of connections, faults included; arr_time may be null at the end of a day."""
    e = F.col("event_id")
    mode = F.when((F.col("event_type") == "error") & (e % 3 == 0), 4).when(e % 20 == 0, 1).when(e % 20 == 1, 2).otherwise(0)
    trip = F.col("user_id") * 100000 + F.col("day")
    stop = lambda k: F.concat(F.lit("stop/"), F.col(k))
    delays = F.map_from_arrays(F.array(F.lit("departureDelay"), F.lit("arrivalDelay")), F.array((60 * (e % 5)).cast("string"), (60 * (e % 3)).cast("string")))
    return hops.select(
        F.concat(F.lit("conn/"), e).alias("conn_id"), stop("dep_k").alias("dep_stop"), stop("arr_k").alias("arr_stop"), "dep_time", (F.col("arr_time") - F.col("dep_time")).cast("int").alias("travel_time"), "arr_time",
        mode.cast("smallint").alias("mode"), F.concat(F.lit("trip/"), trip).alias("trip_id"), delays.alias("attributes"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = hops(spark, sf_dir).where(F.col("arr_time").isNotNull() & (F.col("arr_time") > F.col("dep_time")) & (F.col("arr_k") != F.col("dep_k")) & (F.col("arr_time") - F.col("dep_time") <= MOST_TRAVEL))
    return raw_connections(clean)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of the connections, with route and operator."""
    h = hops(spark, sf_dir).where(F.col("arr_time").isNotNull() & (F.col("arr_time") > F.col("dep_time")) & (F.col("arr_k") != F.col("dep_k")) & (F.col("arr_time") - F.col("dep_time") <= MOST_TRAVEL))
    rows = h.select("user_id", "day").distinct()
    route = (F.col("user_id") % 10).cast("string")
    return rows.select(
        F.concat(F.lit("trip/"), F.col("user_id") * 100000 + F.col("day")).alias("trip_id"), F.concat(F.lit("operator/"), F.col("user_id") % 5).alias("operator_id"),
        F.map_from_arrays(F.array(F.lit("route"), F.lit("route_type"), F.lit("headsign")), F.array(route, (F.col("user_id") % 10 % 4).cast("string"), F.concat(F.lit("to "), route))).alias("attributes"),
    )


def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("operator/"), "r_regionkey").alias("operator_id"), F.create_map(F.lit("name"), F.col("r_name")).alias("attributes"))


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    return Snapshot(operators(spark, sf_dir), stops(spark, sf_dir), trips(spark, sf_dir), connections(spark, sf_dir), "derived")


def gtfs_feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a feed: suppliers are stops, orders are trips, line items are stop times, customers are routes, nations are agencies."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    times = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.row_number().over(order).alias("seq"))
    secs = 21600 + (F.col("l_orderkey") % 720) * 60 + F.col("seq") * 600
    clock = lambda s: F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    calendar = spark.range(7).select(text("id").alias("service_id"), *[(F.col("id") == i).cast("int").alias(d) for i, d in enumerate(days)], F.lit("20200101").alias("start_date"), F.lit("20201231").alias("end_date"))
    return {
        "agency": table(spark, sf_dir, "nation").select(text("n_nationkey").alias("agency_id"), F.col("n_name").alias("agency_name"), F.lit("https://example.org").alias("agency_url"), F.lit("UTC").alias("agency_timezone")),
        "stops": table(spark, sf_dir, "supplier").select(text("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), none.alias("stop_url"), (51.0 + F.col("s_suppkey") % 100 * 0.002).alias("stop_lat"), (3.0 + F.floor(F.col("s_suppkey") / 100) * 0.003).alias("stop_lon")),
        "routes": table(spark, sf_dir, "customer").select(text("c_custkey").alias("route_id"), text("c_nationkey").alias("agency_id"), F.col("c_name").alias("route_short_name"), F.lit("3").alias("route_type")),
        "trips": table(spark, sf_dir, "orders").select(text("o_custkey").alias("route_id"), (F.col("o_orderkey") % 7).cast("string").alias("service_id"), text("o_orderkey").alias("trip_id")),
        "stop_times": times.select(text("l_orderkey").alias("trip_id"), clock(secs).alias("arrival_time"), clock(secs).alias("departure_time"), text("l_suppkey").alias("stop_id"), F.col("seq").alias("stop_sequence"), (F.col("seq") % 4 == 3).cast("int").alias("pickup_type"), (F.col("seq") % 5 == 4).cast("int").alias("drop_off_type")),
        "calendar": calendar,
        "calendar_dates": spark.createDataFrame([("0", "20200107", 1), ("1", "20200107", 2)], "service_id string, date string, exception_type int"),
    }
