"""GTFS feeds: seven tables to a snapshot, trips times service days expanded by joins."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsers import clock_seconds
from ..model import Snapshot, create_mode
from ..storage import exists

FILES = ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates")
OPTIONAL = ("calendar", "calendar_dates", "routes")
EMPTY = {"calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string", "calendar_dates": "service_id string, date string, exception_type int", "routes": "route_id string, agency_id string"}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Attributes of stops and routes kept from the feed, by column (fixed values).
STOP_ATTRIBUTES = {"name": "stop_name", "code": "stop_code", "description": "stop_desc", "parent_station": "parent_station", "platform": "platform_code", "levelid": "level_id", "wheelchairboarding": "wheelchair_boarding", "zone": "zone_id"}
ROUTE_ATTRIBUTES = {"route": "route_id", "shortname": "route_short_name", "longname": "route_long_name", "description": "route_desc", "type": "route_type", "url": "route_url", "color": "route_color", "textcolor": "route_text_color"}
TRIP_ATTRIBUTES = {"headsign": "trip_headsign", "tripshortname": "trip_short_name", "direction": "direction_id", "block": "block_id", "shape": "shape_id"}


@dataclass(frozen=True)
class Settings:
    add_unused_stops: bool = False
    add_unused_trips: bool = False
    use_calendar_range: bool = True
    legacy_gtfs_mode: bool = False
    translations: dict[str, str] = field(default_factory=dict)


#: Files whose texts may hold line breaks: small ones, since such a file is read by one task. The others are split.
MULTI_LINE = ("agency", "stops", "routes")


def read_feed(spark: SparkSession, path: str, multi_line: tuple[str, ...] = MULTI_LINE) -> dict[str, DataFrame]:
    """The tables of an unpacked feed folder; those the standard lets be absent are empty. multi_line: files with quoted line breaks."""
    read = lambda name: spark.read.csv(f"{path}/{name}.txt", header=True, escape='"', multiLine=name in multi_line)
    found = {}
    for name in FILES:
        if exists(spark, f"{path}/{name}.txt"):
            found[name] = read(name)
        elif name in OPTIONAL:
            found[name] = spark.createDataFrame([], EMPTY[name])
        else:
            raise FileNotFoundError(f"{path}/{name}.txt")
    return found


def _get(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _attributes(df: DataFrame, names: dict[str, str]) -> Column:
    """Those attributes that have a value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), _get(df, c).alias("v")) for k, c in names.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull() & (p["v"] != "")))


def id_prefix(agency: DataFrame) -> str:
    """The agencies' common URL with a slash behind it; empty if they have none in common."""
    urls = [r["agency_url"] for r in agency.select("agency_url").distinct().limit(2).collect()]
    return re.sub(r"/*$", "/", urls[0]) if len(urls) == 1 and urls[0] else ""


def agencies(agency: DataFrame, prefix: str) -> DataFrame:
    own = F.lit(prefix) if prefix else _get(agency, "agency_id")
    names = {"name": "agency_name", "website": "agency_url", "lang": "agency_lang", "telephone": "agency_phone", "email": "agency_email", "charge:url": "agency_fare_url", "timezone": "agency_timezone"}
    rows = agency.select(own.alias("operator_id"), _get(agency, "agency_id").alias("a"), _attributes(agency, names).alias("attributes"))
    order = Window.partitionBy("operator_id").orderBy("a")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("operator_id", "attributes")


def stop_id(stops: DataFrame, prefix: str) -> Column:
    return F.coalesce(F.nullif(_get(stops, "stop_url"), F.lit("")), F.concat(F.lit(f"{prefix}stop/"), _get(stops, "stop_id")))


def stops_of(stops: DataFrame, prefix: str, translations: DataFrame | None = None) -> DataFrame:
    """Stops; translations (trans_id, lang, translation) of a name become name:{lang}."""
    rows = stops.select(stop_id(stops, prefix).alias("stop_id"), _get(stops, "stop_lon").cast("double").alias("lon"), _get(stops, "stop_lat").cast("double").alias("lat"), _attributes(stops, STOP_ATTRIBUTES).alias("attributes"), _get(stops, "stop_name").alias("n"))
    if translations is not None:
        own = translations.groupBy(F.col("trans_id").alias("n")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("name:"), "lang"), "translation"))).alias("t"))
        rows = rows.join(own, "n", "left").withColumn("attributes", F.when(F.col("t").isNull(), F.col("attributes")).otherwise(F.map_concat("attributes", "t")))
    return rows.select("stop_id", "lon", "lat", "attributes").dropDuplicates(["stop_id"])


def active_days(calendar: DataFrame, calendar_dates: DataFrame, start: date, end: date, use_range: bool = True) -> DataFrame:
    """(service_id, day) of the days from start to end, both included, on which a service runs: an exception overrides the week."""
    flags = F.array(*[F.col(d).cast("int") for d in DAYS])
    within = F.col("day").between(F.to_date("start_date", "yyyyMMdd"), F.to_date("end_date", "yyyyMMdd")) if use_range else F.lit(True)
    # Days of the request are few: one row for each comes from the week's flags.
    week = calendar.select("service_id", flags.alias("flags"), "start_date", "end_date", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    week = week.select("service_id", "day", ((F.element_at("flags", F.weekday("day") + 1) == 1) & F.coalesce(within, F.lit(True))).alias("planned"))
    change = calendar_dates.select("service_id", F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("day"), (F.col("exception_type").cast("int") == 1).alias("added")).where(F.col("day").between(F.lit(start), F.lit(end)))
    change = change.groupBy("service_id", "day").agg(F.bool_or("added").alias("added"))
    both = week.join(change, ["service_id", "day"], "full_outer")
    return both.where(F.coalesce("added", "planned", F.lit(False))).select("service_id", "day")


def hops_of(stop_times: DataFrame) -> DataFrame:
    """Stop times of a trip in pairs: (trip, seq, dep_stop, arr_stop, dep_secs, arr_secs, get_on, get_off). Types 0 or none are regular."""
    order = Window.partitionBy("trip").orderBy("seq")
    st = stop_times.select(
        F.col("trip_id").cast("string").alias("trip"), F.col("stop_sequence").cast("int").alias("seq"), F.col("stop_id").cast("string").alias("dep_stop"), clock_seconds(F.coalesce("departure_time", "arrival_time")).alias("dep_secs"), clock_seconds(F.coalesce("arrival_time", "departure_time")).alias("at"),
        (F.coalesce(_get(stop_times, "pickup_type").cast("int"), F.lit(0)) != 1).alias("get_on"), (F.coalesce(_get(stop_times, "drop_off_type").cast("int"), F.lit(0)) != 1).alias("off"),
    )
    paired = st.select("trip", "seq", "dep_stop", F.lead("dep_stop").over(order).alias("arr_stop"), "dep_secs", F.lead("at").over(order).alias("arr_secs"), "get_on", F.lead("off").over(order).alias("get_off"))
    return paired.where("arr_stop IS NOT NULL")


def load(feed: dict[str, DataFrame], start: date, end: date, settings: Settings = Settings(), translations: DataFrame | None = None) -> Snapshot:
    """The snapshot of all service days from start to end, both included."""
    if isinstance(start, datetime) or isinstance(end, datetime):
        raise ValueError("start and end must be dates without a time")
    prefix = id_prefix(feed["agency"])
    zone = feed["agency"].agg(F.min("agency_timezone")).first()[0] or "UTC"
    days = active_days(feed["calendar"], feed["calendar_dates"], start, end, settings.use_calendar_range)
    trips, routes = feed["trips"], feed["routes"]
    sole = feed["agency"].count() == 1
    agency = F.lit(prefix) if prefix else F.coalesce(F.nullif(F.col("agency"), F.lit("")), F.lit(feed["agency"].first()["agency_id"]) if sole else F.lit(None))
    own = trips.select(F.col("trip_id").cast("string").alias("trip"), F.col("service_id").cast("string").alias("service_id"), F.col("route_id").cast("string").alias("route"), _attributes(trips, TRIP_ATTRIBUTES).alias("t"))
    named = routes.select(F.col("route_id").cast("string").alias("route"), _get(routes, "agency_id").alias("agency"), _attributes(routes, ROUTE_ATTRIBUTES).alias("r")).dropDuplicates(["route"])
    runs = own.join(days, "service_id").join(named, "route", "left").withColumn("stamp", F.date_format("day", "yyyyMMdd"))
    trip_id = F.concat(F.lit(f"{prefix}trip/"), "trip", F.lit("/"), "stamp")
    empty = F.expr("cast(map() as map<string,string>)")
    out_trips = runs.select(trip_id.alias("trip_id"), agency.alias("operator_id"), F.map_concat(F.coalesce("t", empty), F.coalesce("r", empty)).alias("attributes"))
    place = feed["stops"].select(F.col("stop_id").cast("string").alias("raw"), stop_id(feed["stops"], prefix).alias("id"))
    hops = hops_of(feed["stop_times"])
    for side in ("dep_stop", "arr_stop"):
        hops = hops.join(place.withColumnsRenamed({"raw": side, "id": f"{side}_id"}), side).drop(side).withColumnRenamed(f"{side}_id", side)
    midnight = F.unix_timestamp(F.to_utc_timestamp(F.col("day").cast("timestamp"), zone))
    mode = create_mode(F.col("get_on"), F.col("get_off"))
    if settings.legacy_gtfs_mode:
        mode = F.when(F.col("get_on") & F.col("get_off"), 3).when(~F.col("get_on") & ~F.col("get_off"), 0).otherwise(mode).cast("smallint")
    c = hops.join(runs.select("trip", "day", "stamp"), "trip")
    connections = c.select(
        F.concat(F.lit(f"{prefix}connection/"), "trip", F.lit("/"), "stamp", F.lit("/"), "seq").alias("conn_id"), "dep_stop", "arr_stop", (midnight + F.col("dep_secs")).alias("dep_time"), (F.col("arr_secs") - F.col("dep_secs")).cast("int").alias("travel_time"),
        (midnight + F.col("arr_secs")).alias("arr_time"), mode.alias("mode"), trip_id.alias("trip_id"), empty.alias("attributes"),
    )
    stops = stops_of(feed["stops"], prefix, translations)
    snap = Snapshot(agencies(feed["agency"], prefix), stops, out_trips, connections, prefix or "gtfs")
    from ..operators.filters import used_stops, used_trips

    if not settings.add_unused_stops:
        snap = snap.with_tables(stops=used_stops(stops, connections))
    if not settings.add_unused_trips:
        snap = snap.with_tables(trips=used_trips(out_trips, connections))
    return snap
