"""Linked Connections: pages of JSON-LD to connections, locations to stops."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Snapshot, create_mode
from ..storage import write_text

_TEXT = T.StringType()
PAGE = T.StructType([T.StructField("@id", _TEXT), T.StructField("hydra:next", _TEXT), T.StructField("hydra:previous", _TEXT), T.StructField("@graph", T.ArrayType(T.StructType([
    *[T.StructField(n, _TEXT) for n in ("@id", "@type", "departureStop", "arrivalStop", "departureTime", "arrivalTime", "departureDelay", "arrivalDelay", "gtfs:trip", "gtfs:route", "headsign", "gtfs:pickupType", "gtfs:dropOffType")],
])))])
LOCATIONS = T.StructType([T.StructField("@graph", T.ArrayType(T.StructType([T.StructField("@id", _TEXT), T.StructField("name", _TEXT), T.StructField("latitude", _TEXT), T.StructField("longitude", _TEXT), T.StructField("alternative", T.ArrayType(T.StructType([T.StructField("@language", _TEXT), T.StructField("@value", _TEXT)])))])))])
#: Kinds of connections (fixed values); others are errors.
KINDS = ("Connection", "CancelledConnection")


class UnknownKind(ValueError):
    """A connection of a kind that is not known."""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", True).json(path)


def parse_connections(pages: DataFrame) -> DataFrame:
    """A row for each connection of the pages, as found: times include delays; a backward one is kept here with ok false."""
    c = pages.select(F.explode("@graph").alias("c")).select("c.*")
    seconds = lambda n: F.unix_timestamp(F.try_to_timestamp(F.col(n)))
    regular = lambda n: F.col(n).isNull() | F.col(n).endswith("Regular")
    kind = F.regexp_extract(F.coalesce(F.col("`@type`"), F.lit("")), r"([A-Za-z]+)$", 1)
    return c.select(
        F.col("`@id`").alias("conn_id"), F.col("departureStop").alias("dep_stop"), F.col("arrivalStop").alias("arr_stop"), seconds("departureTime").alias("dep_time"), seconds("arrivalTime").alias("arr_time"),
        F.coalesce(F.col("departureDelay").cast("int"), F.lit(0)).alias("dep_delay"), F.coalesce(F.col("arrivalDelay").cast("int"), F.lit(0)).alias("arr_delay"), F.col("`gtfs:trip`").alias("trip_id"), F.col("`gtfs:route`").alias("route"), "headsign",
        regular("`gtfs:pickupType`").alias("get_on"), regular("`gtfs:dropOffType`").alias("get_off"), kind.alias("kind"),
    ).withColumn("ok", F.coalesce(F.col("arr_time") >= F.col("dep_time"), F.lit(False)))


def lc_mode(get_on: Column, get_off: Column, cancelled: Column) -> Column:
    return create_mode(get_on, get_off, cancelled)


def connections_of(parsed: DataFrame) -> DataFrame:
    attributes = F.map_from_arrays(F.array(F.lit("departureDelay"), F.lit("arrivalDelay")), F.array(F.col("dep_delay").cast("string"), F.col("arr_delay").cast("string")))
    return parsed.where("ok").select("conn_id", "dep_stop", "arr_stop", "dep_time", (F.col("arr_time") - F.col("dep_time")).cast("int").alias("travel_time"), "arr_time", lc_mode(F.col("get_on"), F.col("get_off"), F.col("kind") == "CancelledConnection").alias("mode"), "trip_id", attributes.alias("attributes"))


def rejects(parsed: DataFrame) -> DataFrame:
    """Connections left out, with the reason."""
    return parsed.where("NOT ok").select("conn_id", F.when(F.col("arr_time").isNull() | F.col("dep_time").isNull(), "no time").otherwise("arrives before it leaves").alias("reason"))


def trips_of(parsed: DataFrame) -> DataFrame:
    """One trip for each trip uri, without operator; attributes headsign, trip, route."""
    pair = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    pairs = F.array(pair("headsign", "headsign"), pair("trip", "trip_id"), pair("route", "route"))
    rows = parsed.where("ok").select("trip_id", F.lit(None).cast("string").alias("operator_id"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("attributes"), "conn_id")
    order = Window.partitionBy("trip_id").orderBy("conn_id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "conn_id")


def locations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LOCATIONS).option("multiLine", True).json(path).select(F.explode("@graph").alias("l")).select("l.*")
    pairs = F.concat(F.array(F.struct(F.lit("name").alias("k"), F.col("name").alias("v"))), F.coalesce(F.transform("alternative", lambda a: F.struct(F.concat(F.lit("name:"), a["@language"]).alias("k"), a["@value"].alias("v"))), F.expr("cast(array() as array<struct<k:string,v:string>>)")))
    own = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull() & p["k"].isNotNull()))
    return rows.select(F.col("`@id`").alias("stop_id"), F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat"), own.alias("attributes"))


def validate(parsed: DataFrame, stops: DataFrame) -> DataFrame:
    """Without connections that stay where they are, touch an unknown stop or none; of those alike in id the first stays."""
    known = stops.select("stop_id")
    rows = parsed.where((F.col("dep_stop") != F.col("arr_stop")) & F.col("dep_stop").isNotNull() & F.col("arr_stop").isNotNull())
    for end in ("dep_stop", "arr_stop"):
        rows = rows.join(known.select(F.col("stop_id").alias(end)), end, "left_semi")
    order = Window.partitionBy("conn_id").orderBy("dep_time", "arr_time", "dep_stop", "arr_stop")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth").select(*parsed.columns)


# --- pages and downloads ------------------------------------------------------------------------------------------------


def page_uri(base: str, at: datetime) -> str:
    """The page that holds a minute."""
    at = at.astimezone(timezone.utc).replace(second=0, microsecond=0)
    return f"{base}?departureTime={at.strftime('%Y-%m-%dT%H:%M:%S')}.000Z"


def page_uri_column(base: str, at: Column) -> Column:
    return F.concat(F.lit(f"{base}?departureTime="), F.date_format(F.date_trunc("minute", at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def page_time(uri: Column) -> Column:
    """The time in a page's uri."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(uri, r"departureTime=([^&#]+)", 1), F.lit("")))


class Downloader:
    """GET with a timeout, retries, without fragments; and whether the answer is the same as before."""

    def __init__(self, timeout: float = 20, retries: int = 5, fetch: Callable[[str, float], bytes] | None = None):
        self.timeout, self.retries = timeout, retries
        self.fetch = fetch or (lambda uri, t: urllib.request.urlopen(uri, timeout=t).read())  # noqa: S310
        self.seen: dict[str, int] = {}

    def load(self, uri: str) -> tuple[str, bool]:
        uri = uri.split("#")[0]
        for attempt in range(self.retries):
            try:
                text = self.fetch(uri, self.timeout).decode()
                break
            except OSError:
                if attempt + 1 == self.retries:
                    raise
                time.sleep(0.01 * 2**attempt)
        unchanged = self.seen.get(uri) == hash(text)
        self.seen[uri] = hash(text)
        return text, unchanged


def crawl(base: str, start: datetime, end: datetime, downloader: Downloader) -> Iterator[tuple[str, str, bool]]:
    """(uri, text, unchanged) of the pages from start on until one reaches end."""
    uri: str | None = page_uri(base, start)
    while uri:
        text, unchanged = downloader.load(uri)
        yield uri, text, unchanged
        page = json.loads(text)
        follow = page.get("hydra:next")
        if follow is None or _time_of(follow) >= end:
            return
        uri = follow


def _time_of(uri: str) -> datetime:
    return datetime.fromisoformat(uri.split("departureTime=")[1].split("&")[0].replace("Z", "+00:00"))


def download_pages(spark: SparkSession, base: str, start: datetime, end: datetime, folder: str, downloader: Downloader | None = None) -> tuple[int, int]:
    """Writes changed pages to a folder of any store that Spark knows; returns pages (loaded, reused)."""
    loaded = reused = 0
    for uri, text, unchanged in crawl(base, start, end, downloader or Downloader()):
        if unchanged:
            reused += 1
            continue
        loaded += 1
        write_text(spark, f"{folder}/{_time_of(uri).strftime('%Y%m%dT%H%M')}.json", text)
    return loaded, reused


def use_linked_connections(spark: SparkSession, connections: str, locations_uri: str, start: datetime, end: datetime, folder: str, downloader: Downloader | None = None) -> Snapshot:
    """Downloads the pages of a window and the locations to a folder, and reads them. The snapshot names where they came from."""
    loader = downloader or Downloader()
    download_pages(spark, connections, start, end, f"{folder}/pages", loader)
    write_text(spark, f"{folder}/locations.json", loader.load(locations_uri)[0])
    snap = read_linked_connections(spark, f"{folder}/pages", f"{folder}/locations.json", int(start.timestamp()), int(end.timestamp()), connections)
    return replace(snap, meta={"source": connections, "locations": locations_uri})


def read_linked_connections(spark: SparkSession, pages: str, stops: str, start: int, end: int, uri: str = "") -> Snapshot:
    """The snapshot of downloaded pages and locations for departures in [start, end)."""
    places = locations(spark, stops)
    parsed = parse_connections(read_pages(spark, pages))
    strange = parsed.where(~F.col("kind").isin(*KINDS)).select("kind").limit(1).collect()
    if strange:
        raise UnknownKind(strange[0]["kind"])
    good = validate(parsed, places).where((F.col("dep_time") >= start) & (F.col("dep_time") < end))
    connections = connections_of(good)
    operators = spark.createDataFrame([], "operator_id string, attributes map<string,string>")
    return Snapshot(operators, places, trips_of(good), connections, uri or pages, {"source": pages, "locations": stops})


def minutes(start: datetime, end: datetime, step: timedelta) -> list[datetime]:
    return [start + k * step for k in range(int((end - start) / step) + 1)]
