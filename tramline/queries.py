"""Named queries over the derived timetable, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cli, derive
from .functions import geo, parsers
from .model import CANCELLED, Snapshot, attribute, can_get_off, can_get_on, connection_errors, is_cancelled, stop_name
from .operators import aggregates, filters, journeys, pareto, sets, validate, walks
from .plans import rounds
from .plans.planner import Planner, Profile, plan
from .sources import gtfs, lc, osm, sinks, snapshots
from .storage import shared_dir
from .streaming import refresh

#: The window that journeys are asked for: a day of the derived timetable.
START, END = 1705276800, 1705276800 + 86400
#: Service days of the derived feed.
FIRST, LAST = date(2020, 1, 6), date(2020, 1, 12)
METRES = 500.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"
BASE = f"""WITH visits AS MATERIALIZED (SELECT event_id, user_id, event_type, {EPOCH} AS t, CAST(floor({EPOCH} / 86400) AS BIGINT) AS day, (event_id * 7 + user_id) % 25 AS k FROM events),
hops AS MATERIALIZED (SELECT event_id, user_id, event_type, day, t AS dep_time, k AS dep_k, lead(t) OVER w AS arr_time, lead(k) OVER w AS arr_k FROM visits WINDOW w AS (PARTITION BY user_id, day ORDER BY t, event_id)),
r AS MATERIALIZED (SELECT concat('conn/', event_id) AS conn_id, concat('stop/', dep_k) AS dep_stop, concat('stop/', arr_k) AS arr_stop, dep_time, CAST(arr_time - dep_time AS INTEGER) AS travel_time, arr_time,
 CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 4 WHEN event_id % 20 = 0 THEN 1 WHEN event_id % 20 = 1 THEN 2 ELSE 0 END AS mode, concat('trip/', user_id * 100000 + day) AS trip_id,
 60 * (event_id % 5) AS dep_delay, 60 * (event_id % 3) AS arr_delay, dep_k, arr_k, event_id, user_id, day FROM hops),
c AS MATERIALIZED (SELECT * FROM r WHERE arr_time IS NOT NULL AND arr_time > dep_time AND arr_k <> dep_k AND arr_time - dep_time <= 65535),
st AS MATERIALIZED (SELECT concat('stop/', n_nationkey) AS stop_id, n_name AS name, 3.0::DOUBLE + (n_nationkey % 5) * 0.004::DOUBLE AS lon, 51.0::DOUBLE + floor(n_nationkey / 5) * 0.003::DOUBLE AS lat FROM nation),
tr AS MATERIALIZED (SELECT DISTINCT trip_id, concat('operator/', user_id % 5) AS operator_id, CAST(user_id % 10 AS VARCHAR) AS route, CAST(user_id % 10 % 4 AS VARCHAR) AS route_type, concat('to ', user_id % 10) AS headsign FROM c),
"""
DIST = "(sqrt(pow(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(radians(b.lat - a.lat), 2)) * 6371000.0)"
FOOT = f"fp AS MATERIALIZED (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, CAST(floor(round(1.4 * {DIST}, 6)) AS INTEGER) AS secs FROM st a, st b WHERE a.stop_id <> b.stop_id AND {DIST} <= {METRES})"
WINDOWED = f"w AS MATERIALIZED (SELECT * FROM c WHERE dep_time >= {START} AND dep_time < {END} AND mode & {CANCELLED} = 0)"
CONN = "conn_id, dep_stop, arr_stop, dep_time, travel_time, mode, trip_id"


def sql(body: str, *ctes: str) -> str:
    return BASE + ",\n".join([*ctes, "one AS (SELECT 1 AS x)"]) + "\n" + body


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def conns(df: DataFrame) -> DataFrame:
    return df.select("conn_id", "dep_stop", "arr_stop", "dep_time", "travel_time", F.col("mode").cast("int").alias("mode"), "trip_id")


def snapshot(spark: SparkSession, d: str) -> Snapshot:
    return derive.snapshot(spark, d)


# --- 2.3 filters, projections ------------------------------------------------------------------------------------------


@query("flt_01_select_time", sql(f"SELECT {CONN} FROM c WHERE dep_time >= {START} AND dep_time < {END}"))
def _(spark, d):
    return conns(filters.select_time(snapshot(spark, d), START, END).connections)


@query("flt_02_select_bbox", sql(f"SELECT {CONN} FROM c WHERE dep_stop IN (SELECT stop_id FROM st WHERE lat BETWEEN 51.0 AND 51.0065 AND lon BETWEEN 3.003 AND 3.013) AND arr_stop IN (SELECT stop_id FROM st WHERE lat BETWEEN 51.0 AND 51.0065 AND lon BETWEEN 3.003 AND 3.013)"))
def _(spark, d):
    return conns(filters.select_bounding_box(snapshot(spark, d), 3.003, 51.0, 3.013, 51.0065).connections)


@query("flt_03_select_stop", sql(f"SELECT {CONN} FROM c WHERE dep_stop IN ('stop/3', 'stop/7') OR arr_stop IN ('stop/3', 'stop/7')"))
def _(spark, d):
    return conns(filters.select_stops(snapshot(spark, d), "stop/3;stop/7").connections)


@query("flt_04_select_trip", sql(f"SELECT {CONN} FROM c WHERE trip_id = 'trip/1019737'"))
def _(spark, d):
    return conns(filters.select_trip(snapshot(spark, d), "trip/1019737").connections)


@query("flt_05_remove_unused", sql("SELECT 'stop' AS kind, stop_id AS id FROM st WHERE stop_id IN (SELECT dep_stop FROM s UNION ALL SELECT arr_stop FROM s) UNION ALL SELECT 'trip', trip_id FROM tr WHERE trip_id IN (SELECT trip_id FROM s)", "s AS (SELECT * FROM c WHERE mode = 1 AND travel_time < 3600)"))
def _(spark, d):
    snap = snapshot(spark, d)
    own = filters.remove_unused(snap.with_tables(connections=snap.connections.where("mode = 1 AND travel_time < 3600")))
    return own.stops.select(F.lit("stop").alias("kind"), F.col("stop_id").alias("id")).unionByName(own.trips.select(F.lit("trip").alias("kind"), F.col("trip_id").alias("id")))


@query("flt_06_copy", sql("SELECT conn_id, dep_time + 60 AS dep_time, trip_id FROM c WHERE mode = 0 AND trip_id IN (SELECT trip_id FROM tr WHERE operator_id = 'operator/1')"))
def _(spark, d):
    later = lambda df: df.withColumn("dep_time", F.col("dep_time") + 60)
    out = filters.copy(snapshot(spark, d), keep_trip=F.col("operator_id") == "operator/1", keep_connection=F.col("mode") == 0, modify_connection=later)
    return out.connections.select("conn_id", "dep_time", "trip_id")


@query("flt_07_cancelled_filter", sql(f"SELECT {CONN} FROM c WHERE mode & 4 = 0"))
def _(spark, d):
    return conns(derive.connections(spark, d).where(filters.not_cancelled()))


@query("flt_08_filter_and", sql(f"SELECT {CONN} FROM c WHERE mode & 4 = 0 AND travel_time < 3600 AND dep_stop = 'stop/5'"))
def _(spark, d):
    keep = filters.filter_and(filters.not_cancelled(), None, F.col("travel_time") < 3600, F.col("dep_stop") == "stop/5")
    return conns(derive.connections(spark, d).where(keep))


@query("flt_11_max_transfers", None)
def _(spark, d):
    return _profile(spark, d).where(filters.max_transfers(1))


@query("prj_01_attribute_access", sql("SELECT trip_id, route, route_type, 'none' AS colour FROM tr"))
def _(spark, d):
    return derive.trips(spark, d).select("trip_id", attribute("route").alias("route"), attribute("route_type").alias("route_type"), attribute("colour", "none").alias("colour"))


@query("prj_02_remove_delays", sql("SELECT conn_id, dep_time - dep_delay AS dep_time, CAST(arr_time - arr_delay - (dep_time - dep_delay) AS INTEGER) AS travel_time, arr_time - arr_delay AS arr_time FROM c"))
def _(spark, d):
    return filters.remove_delays(derive.connections(spark, d)).select("conn_id", "dep_time", "travel_time", "arr_time")


@query("prj_03_stop_name", sql("SELECT stop_id, coalesce(name, '') AS name FROM st"))
def _(spark, d):
    return derive.stops(spark, d).select("stop_id", stop_name().alias("name"))


@query("prj_04_connection_predicates", sql("SELECT conn_id, mode % 4 IN (0, 1) AS can_on, mode % 4 IN (0, 2) AS can_off, mode & 4 <> 0 AS cancelled FROM c"))
def _(spark, d):
    return derive.connections(spark, d).select("conn_id", can_get_on().alias("can_on"), can_get_off().alias("can_off"), is_cancelled().alias("cancelled"))


# --- 2.4 joins ---------------------------------------------------------------------------------------------------------


@query("join_01_lookup_by_id", sql("SELECT c.conn_id, a.name AS dep_name, b.name AS arr_name, tr.route FROM c JOIN st a ON a.stop_id = c.dep_stop JOIN st b ON b.stop_id = c.arr_stop JOIN tr ON tr.trip_id = c.trip_id"))
def _(spark, d):
    snap = snapshot(spark, d)
    name = lambda end: snap.stops.select(F.col("stop_id").alias(f"{end}_stop"), stop_name().alias(f"{end}_name"))
    return snap.connections.join(name("dep"), "dep_stop").join(name("arr"), "arr_stop").join(snap.trips.select("trip_id", attribute("route").alias("route")), "trip_id").select("conn_id", "dep_name", "arr_name", "route")


@query("join_02_lookup_by_global_id", sql("SELECT stop_id, name FROM st WHERE stop_id IN ('stop/4', 'stop/17')"))
def _(spark, d):
    return filters.lookup(derive.stops(spark, d), "stop_id", ["stop/4", "stop/17"]).select("stop_id", stop_name().alias("name"))


@query("join_03_get_all", sql("SELECT pos, st.stop_id, name FROM (VALUES (0, 'stop/9'), (1, 'stop/2'), (2, 'stop/9')) v(pos, stop_id) JOIN st ON st.stop_id = v.stop_id"))
def _(spark, d):
    return filters.find_stops(derive.stops(spark, d), ["stop/9", "stop/2", "stop/9"]).select("pos", "stop_id", stop_name().alias("name"))


@query("join_04_stops_in_range", sql(f"SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, round({DIST}, 3) AS dist FROM st a, st b WHERE {DIST} <= {METRES}"))
def _(spark, d):
    stops = derive.stops(spark, d)
    return geo.pairs_in_range(stops, stops, METRES).select("from_stop", "to_stop", F.round("dist", 3).alias("dist"))


SUPPLIERS = "su AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, 51.0::DOUBLE + s_suppkey % 100 * 0.002::DOUBLE AS lat, 3.0::DOUBLE + floor(s_suppkey / 100) * 0.003::DOUBLE AS lon FROM supplier)"


@query("join_04_suppliers_in_range", sql(f"SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, round({DIST}, 3) AS dist FROM su a, su b WHERE {DIST} <= 1000.0", SUPPLIERS))
def _(spark, d):
    stops = derive.gtfs_feed(spark, d)["stops"].select("stop_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))
    return geo.pairs_in_range(stops, stops, 1000.0).select("from_stop", "to_stop", F.round("dist", 3).alias("dist"))


@query("join_05_walk_pairs", sql("SELECT from_stop, to_stop, secs FROM fp", FOOT))
def _(spark, d):
    return walks.footpaths(derive.stops(spark, d), walks.CrowFlight(METRES))


@query(
    "join_07_next_departure",
    sql("SELECT a.stop, a.arrival, min(n.dep_time) AS dep_time FROM a LEFT JOIN w n ON n.dep_stop = a.stop AND n.dep_time >= a.arrival + 180 GROUP BY a.stop, a.arrival", WINDOWED, "a AS (SELECT DISTINCT arr_stop AS stop, arr_time AS arrival FROM w)"),
)
def _(spark, d):
    w = rounds.in_window(derive.connections(spark, d), START, END)
    arrivals = w.select(F.col("arr_stop").alias("stop"), F.col("arr_time").alias("arrival")).distinct()
    return filters.next_departures(arrivals, w).select("stop", "arrival", "dep_time")


@query("join_08_continuation", sql("SELECT conn_id, lead(conn_id) OVER (PARTITION BY trip_id ORDER BY dep_time, conn_id) AS next_conn FROM c"))
def _(spark, d):
    return filters.continuations(derive.connections(spark, d)).select("conn_id", "next_conn")


# --- 2.4 journeys: labels by rounds ------------------------------------------------------------------------------------

#: Rounds of the SQL; the planner stops by itself when nothing improves, before that.
SQL_ROUNDS = 7


def rounds_sql(seed: str, walk: bool, back: bool = False) -> list[str]:
    """CTEs l0 .. lN (q, stop, t, ready): labels of earliest arrival, or of latest departure."""
    out = [FOOT, WINDOWED if not back else WINDOWED.replace("mode &", f"arr_time <= {END} AND mode &")]
    on, off = "mode % 4 IN (0, 1)", "mode % 4 IN (0, 2)"
    pick, sign, bound = ("max", "-", f">= {START}") if back else ("min", "+", f"<= {END}")
    if back:
        start, hit, step = "w.arr_stop = l.stop AND w.arr_time <= l.ready", off, f"SELECT b.q, w.dep_stop AS stop, max(w.dep_time) AS t FROM b{{i}} b JOIN w ON w.trip_id = b.trip_id AND w.dep_time <= b.bt AND {on} GROUP BY b.q, w.dep_stop"
    else:
        start, hit, step = "w.dep_stop = l.stop AND w.dep_time >= l.ready", on, f"SELECT b.q, w.arr_stop AS stop, min(w.arr_time) AS t FROM b{{i}} b JOIN w ON w.trip_id = b.trip_id AND w.dep_time >= b.bt AND {off} GROUP BY b.q, w.arr_stop"
    foot_from, foot_to = ("to_stop", "from_stop") if back else ("from_stop", "to_stop")

    def walked(source: str) -> str:
        return f" UNION ALL SELECT q, {foot_to}, t {sign} secs, t {sign} secs FROM {source} n JOIN fp ON fp.{foot_from} = n.stop WHERE t {sign} secs {bound}" if walk else ""

    out.append(f"s0 AS ({seed})")
    out.append(f"l0 AS MATERIALIZED (SELECT q, stop, {pick}(t) AS t, {pick}(ready) AS ready FROM (SELECT q, stop, t, t AS ready FROM s0{walked('s0')}) u GROUP BY q, stop)")
    for i in range(1, SQL_ROUNDS + 1):
        out.append(f"b{i} AS MATERIALIZED (SELECT l.q, w.trip_id, {pick}(w.dep_time) AS bt FROM l{i - 1} l JOIN w ON {start} AND {hit} GROUP BY l.q, w.trip_id)")
        out.append(f"n{i} AS MATERIALIZED ({step.format(i=i)})")
        out.append(f"l{i} AS MATERIALIZED (SELECT q, stop, {pick}(t) AS t, {pick}(ready) AS ready FROM (SELECT q, stop, t, ready FROM l{i - 1} UNION ALL SELECT q, stop, t, t {sign} 180 FROM n{i}{walked(f'n{i}')}) u GROUP BY q, stop)")
    return out


FROM_0 = f"SELECT 0 AS q, 'stop/0' AS stop, CAST({START} AS BIGINT) AS t"
TO_0 = f"SELECT 0 AS q, 'stop/0' AS stop, CAST({END} AS BIGINT) AS t"
FROM_ALL = f"SELECT n_nationkey AS q, concat('stop/', n_nationkey) AS stop, CAST({START} AS BIGINT) AS t FROM nation"
TO_ALL = f"SELECT n_nationkey AS q, concat('stop/', n_nationkey) AS stop, CAST({END} AS BIGINT) AS t FROM nation"


def _origin(spark: SparkSession, *stops: int) -> DataFrame:
    return spark.createDataFrame([(k, f"stop/{k}") for k in stops], "query_id int, stop string")


@query("rte_04_isochrone_from", sql(f"SELECT stop, t AS arrival FROM l{SQL_ROUNDS}", *rounds_sql(FROM_0, False)))
def _(spark, d):
    return rounds.earliest_arrivals(derive.connections(spark, d), _origin(spark, 0), START, END).select("stop", "arrival")


@query("rte_04_isochrone_with_walks", sql(f"SELECT stop, t AS arrival FROM l{SQL_ROUNDS}", *rounds_sql(FROM_0, True)))
def _(spark, d):
    paths = walks.footpaths(derive.stops(spark, d), walks.CrowFlight(METRES))
    return rounds.earliest_arrivals(derive.connections(spark, d), _origin(spark, 0), START, END, footpaths=paths).select("stop", "arrival")


@query("rte_05_isochrone_to", sql(f"SELECT stop, t AS departure FROM l{SQL_ROUNDS}", *rounds_sql(TO_0, False, True)))
def _(spark, d):
    return rounds.latest_departures(derive.connections(spark, d), _origin(spark, 0), START, END).select("stop", "departure")


@query("rte_01_earliest_arrival", sql(f"SELECT CAST(q AS INTEGER) AS from_key, stop AS to_stop, t AS arrival FROM l{SQL_ROUNDS} WHERE stop <> concat('stop/', q)", *rounds_sql(FROM_ALL, True)))
def _(spark, d):
    paths = walks.footpaths(derive.stops(spark, d), walks.CrowFlight(METRES))
    out = rounds.earliest_arrivals(derive.connections(spark, d), _origin(spark, *range(25)), START, END, footpaths=paths)
    return out.where(F.col("stop") != F.concat(F.lit("stop/"), "query_id")).select(F.col("query_id").alias("from_key"), F.col("stop").alias("to_stop"), "arrival")


@query("rte_02_latest_departure", sql(f"SELECT CAST(q AS INTEGER) AS to_key, stop AS from_stop, t AS departure FROM l{SQL_ROUNDS} WHERE stop <> concat('stop/', q)", *rounds_sql(TO_ALL, True, True)))
def _(spark, d):
    paths = walks.footpaths(derive.stops(spark, d), walks.CrowFlight(METRES))
    out = rounds.latest_departures(derive.connections(spark, d), _origin(spark, *range(25)), START, END, footpaths=paths)
    return out.where(F.col("stop") != F.concat(F.lit("stop/"), "query_id")).select(F.col("query_id").alias("to_key"), F.col("stop").alias("from_stop"), "departure")


@query("rte_11_multi_source", sql(f"SELECT stop, t AS arrival FROM l{SQL_ROUNDS}", *rounds_sql(FROM_0 + f" UNION ALL SELECT 0, 'stop/24', CAST({START} AS BIGINT)", True)))
def _(spark, d):
    paths = walks.footpaths(derive.stops(spark, d), walks.CrowFlight(METRES))
    both = spark.createDataFrame([(0, "stop/0"), (0, "stop/24")], "query_id int, stop string")
    return rounds.earliest_arrivals(derive.connections(spark, d), both, START, END, footpaths=paths).select("stop", "arrival")


def _requests(spark: SparkSession) -> DataFrame:
    rows = [(a * 25 + b, [f"stop/{a}"], [f"stop/{b}"], START, END) for a in range(25) for b in range(25) if a != b]
    return spark.createDataFrame(rows, "query_id int, from_stops array<string>, to_stops array<string>, start_time bigint, end_time bigint")


def _scans(spark: SparkSession, d: str, kind: str) -> DataFrame:
    found = plan(_requests(spark), Planner(snapshot(spark, d), Profile(walks=walks.CrowFlight(METRES))), kind)
    return found.withColumns({"a": F.floor(F.col("query_id") / 25).cast("int"), "b": (F.col("query_id") % 25).cast("int")})


@query("rte_01_earliest_arrival_scan", ORACLES["rte_01_earliest_arrival"])
def _(spark, d):
    return _scans(spark, d, "earliest").select(F.col("a").alias("from_key"), F.concat(F.lit("stop/"), "b").alias("to_stop"), "arrival")


@query("rte_02_latest_departure_scan", ORACLES["rte_02_latest_departure"])
def _(spark, d):
    return _scans(spark, d, "latest").select(F.col("b").alias("to_key"), F.concat(F.lit("stop/"), "a").alias("from_stop"), "departure")


@query("rte_07_direct_walk", sql("SELECT from_stop, to_stop, secs FROM fp WHERE from_stop IN ('stop/0', 'stop/6') AND to_stop IN ('stop/1', 'stop/7', 'stop/12')", FOOT))
def _(spark, d):
    stops = derive.stops(spark, d)
    return walks.footpaths(stops.where(F.col("stop_id").isin("stop/0", "stop/6")), walks.CrowFlight(METRES), stops.where(F.col("stop_id").isin("stop/1", "stop/7", "stop/12")))


def frontier_sql(source: str, keys: str = "stop") -> str:
    return f"SELECT DISTINCT c0.* FROM {source} c0 WHERE NOT EXISTS (SELECT 1 FROM {source} g WHERE g.{keys} = c0.{keys} AND g.dep >= c0.dep AND g.arr <= c0.arr AND g.vehicles <= c0.vehicles AND (g.dep > c0.dep OR g.arr < c0.arr OR g.vehicles < c0.vehicles))"


def profile_sql(target: str, steps: int = 6, end: int = END) -> list[str]:
    out = [f"w AS MATERIALIZED (SELECT * FROM c WHERE dep_time >= {START} AND dep_time < {end} AND arr_time <= {end} AND mode & 4 = 0)", "rd AS MATERIALIZED (SELECT DISTINCT a.dep_stop AS stop, a.dep_time AS dep, b.arr_stop AS end_stop, b.arr_time AS end_arr FROM w a JOIN w b ON a.trip_id = b.trip_id AND b.dep_time >= a.dep_time WHERE a.mode % 4 IN (0, 1) AND b.mode % 4 IN (0, 2))"]
    out.append(f"u1 AS MATERIALIZED (SELECT DISTINCT stop, dep, end_arr AS arr, 1 AS vehicles FROM rd WHERE end_stop = '{target}')")
    out.append(f"p1 AS MATERIALIZED ({frontier_sql('u1')})")
    for k in range(2, steps + 1):
        out.append(f"u{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION SELECT rd.stop, rd.dep, min(p.arr), p.vehicles + 1 FROM rd JOIN p{k - 1} p ON p.stop = rd.end_stop AND p.dep >= rd.end_arr + 180 WHERE rd.stop <> '{target}' GROUP BY rd.stop, rd.dep, p.vehicles)")
        out.append(f"p{k} AS MATERIALIZED ({frontier_sql(f'u{k}')})")
    return out


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return rounds.profiles(derive.connections(spark, d), ["stop/0"], START, END)


PROFILE = "SELECT stop, dep, arr, vehicles FROM p6 WHERE stop <> 'stop/0'"
QUERIES["rte_06_profile_to"] = _profile
ORACLES["rte_06_profile_to"] = sql(PROFILE, *profile_sql("stop/0"))
ORACLES["flt_11_max_transfers"] = sql(PROFILE + " AND vehicles - 1 <= 1", *profile_sql("stop/0"))


@query("rte_03_all_journeys", sql("SELECT dep, arr, vehicles FROM p6 WHERE stop = 'stop/12'", *profile_sql("stop/0")))
def _(spark, d):
    return _profile(spark, d).where("stop = 'stop/12'").select("dep", "arr", "vehicles")


@query("rte_03_all_journeys_scan", ORACLES["rte_03_all_journeys"])
def _(spark, d):
    own = Planner(snapshot(spark, d), Profile(walks=walks.InternalTransfer())).between("stop/12", "stop/0").window(START, END)
    return own.all_journeys().select(F.col("departure").alias("dep"), F.col("arrival").alias("arr"), "vehicles").distinct()


@query("rte_12_journeys_in_isochrone", ORACLES["rte_03_all_journeys"])
def _(spark, d):
    own = Planner(snapshot(spark, d), Profile(walks=walks.InternalTransfer())).between("stop/12", "stop/0").window(START, END)
    return own.with_isochrone_filter().all_journeys().select(F.col("departure").alias("dep"), F.col("arrival").alias("arr"), "vehicles").distinct()


ISO = f"iso AS MATERIALIZED (SELECT stop, t AS arrival FROM l{SQL_ROUNDS})"


@query("flt_09_isochrone_filter", sql(f"SELECT {CONN} FROM w JOIN iso ON iso.stop = w.dep_stop AND iso.arrival <= w.dep_time", *rounds_sql(FROM_0, False), ISO))
def _(spark, d):
    own = derive.connections(spark, d)
    iso = rounds.earliest_arrivals(own, _origin(spark, 0), START, END).select("stop", "arrival")
    return conns(filters.isochrone_filter(rounds.in_window(own, START, END).withColumn("travel_time", (F.col("arr_time") - F.col("dep_time")).cast("int")), iso))


@query("flt_10_special_case_filter", sql(f"SELECT {CONN} FROM w WHERE dep_stop IN ('stop/1', 'stop/2') OR arr_stop IN ('stop/1', 'stop/2') OR EXISTS (SELECT 1 FROM iso WHERE iso.stop = w.dep_stop AND iso.arrival <= w.dep_time)", *rounds_sql(FROM_0, False), ISO))
def _(spark, d):
    own = derive.connections(spark, d)
    iso = rounds.earliest_arrivals(own, _origin(spark, 0), START, END).select("stop", "arrival")
    return conns(filters.isochrone_filter_with_exceptions(rounds.in_window(own, START, END).withColumn("travel_time", (F.col("arr_time") - F.col("dep_time")).cast("int")), iso, ["stop/1", "stop/2"]))


# --- frontiers and journeys --------------------------------------------------------------------------------------------

TUPLES = f"tu AS MATERIALIZED (SELECT arr_stop AS stop, dep_time AS dep, arr_time AS arr, CAST(1 + event_id % 4 AS INTEGER) AS vehicles FROM c)"


def _tuples(spark: SparkSession, d: str) -> DataFrame:
    number = F.substring_index("conn_id", "/", -1).cast("long")
    return derive.connections(spark, d).select(F.col("arr_stop").alias("stop"), F.col("dep_time").alias("dep"), F.col("arr_time").alias("arr"), (1 + number % 4).cast("int").alias("vehicles"))


@query("par_01_add_to_frontier", sql(frontier_sql("tu"), TUPLES))
def _(spark, d):
    own = _tuples(spark, d)
    return pareto.add_to_frontier(own.where("vehicles <= 2"), own.where("vehicles > 2"))


@query("par_02_is_on_frontier", sql("SELECT stop, dep, arr, vehicles, NOT EXISTS (SELECT 1 FROM tu g WHERE g.stop = c0.stop AND g.dep >= c0.dep AND g.arr <= c0.arr AND g.vehicles <= c0.vehicles AND (g.dep > c0.dep OR g.arr < c0.arr OR g.vehicles < c0.vehicles)) AS on_frontier FROM tu c0 WHERE vehicles = 1", TUPLES))
def _(spark, d):
    own = _tuples(spark, d)
    return pareto.on_frontier(own.where("vehicles > 1"), own.where("vehicles = 1"))


@query("par_03_extend_backwards", sql("SELECT rd.stop, rd.dep, min(p.arr) AS arr, p.vehicles + 1 AS vehicles FROM rd JOIN p1 p ON p.stop = rd.end_stop AND p.dep >= rd.end_arr + 180 GROUP BY rd.stop, rd.dep, p.vehicles", *profile_sql("stop/0", 1)))
def _(spark, d):
    own = rounds.rides(derive.connections(spark, d), START, END)
    last = pareto.prune(own.where("end_stop = 'stop/0'").select("stop", "dep", F.col("end_arr").alias("arr"), F.lit(1).alias("vehicles")))
    return pareto.extend_backwards(own, last)


@query("par_04_combine", sql(frontier_sql("tu"), TUPLES))
def _(spark, d):
    own = _tuples(spark, d)
    return pareto.combine(pareto.prune(own.where("dep % 2 = 0")), pareto.prune(own.where("dep % 2 = 1")))


@query("par_05_metric_compare", sql("SELECT a.k AS a, b.k AS b, CASE WHEN a.v = b.v AND a.t = b.t THEN 0 WHEN a.v <= b.v AND a.t <= b.t THEN -1 WHEN a.v >= b.v AND a.t >= b.t THEN 1 END AS cmp FROM m a, m b", "m AS (SELECT n_nationkey AS k, n_nationkey % 3 AS v, n_nationkey * 7 % 5 AS t FROM nation)"))
def _(spark, d):
    m = derive.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3).alias("v"), (F.col("n_nationkey") * 7 % 5).alias("t"))
    a, b = (m.withColumnsRenamed({"k": x, "v": f"v{x}", "t": f"t{x}"}) for x in "ab")
    # 25 x 25 rows to compare: the fixed set of nations against itself.
    return a.join(b).select("a", "b", pareto.compare(F.col("va"), F.col("ta"), F.col("vb"), F.col("tb")).alias("cmp"))


WEEKS = "wk AS MATERIALIZED (SELECT user_id * 10 + CAST(floor((day - 19723) / 7) AS BIGINT) AS jid, * FROM c)"


def week_journeys(spark: SparkSession, d: str) -> DataFrame:
    """A user's connections of a week as one journey: several trips, with waits between."""
    own = derive.connections(spark, d)
    key = F.substring_index("trip_id", "/", -1).cast("long")
    jid = F.floor(key / 100000) * 10 + F.floor((key % 100000 - 19723) / 7)
    hop = F.struct("dep_time", "conn_id", "arr_time", "trip_id", "dep_stop", "arr_stop")
    own = own.groupBy(jid.cast("int").alias("journey_id")).agg(F.sort_array(F.collect_list(hop)).alias("h"))
    legs = F.transform("h", lambda x: journeys.leg("ride", x["conn_id"], x["trip_id"], x["dep_stop"], x["arr_stop"], x["dep_time"], x["arr_time"]))
    return journeys.measure(own.select(F.lit(0).alias("query_id"), "journey_id", legs.alias("legs")))


@query("par_06_metric_add", sql("SELECT CAST(jid AS INTEGER) AS journey_id, CAST(count(DISTINCT trip_id) AS INTEGER) AS vehicles, CAST(max(arr_time) - min(dep_time) AS BIGINT) AS travel_time FROM wk GROUP BY jid", WEEKS))
def _(spark, d):
    return week_journeys(spark, d).select("journey_id", "vehicles", "travel_time")


FAMILIES = "jn AS MATERIALIZED (SELECT jid, min(dep_time) // 86400 AS dep, max(arr_time) // 86400 AS arr, count(DISTINCT trip_id) AS v, arg_min(dep_stop, dep_time) AS a, arg_max(arr_stop, dep_time) AS b FROM wk GROUP BY jid)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Journeys with times in days and no travel time, so that some are alike."""
    own = week_journeys(spark, d).withColumn("legs", F.array(F.struct(*[F.col("legs")[0][n].alias(n) for n in ("kind", "conn_id", "trip_id", "from_stop")], F.element_at("legs", -1)["to_stop"].alias("to_stop"), F.lit(0).cast("long").alias("dep"), F.lit(0).cast("long").alias("arr"))))
    return own.withColumns({"departure": F.floor(F.col("departure") / 86400), "arrival": F.floor(F.col("arrival") / 86400), "travel_time": F.lit(0)})


@query("par_07_prune_families", sql("SELECT CAST(max(jid) AS INTEGER) AS journey_id FROM jn GROUP BY dep, arr, v, a, b", WEEKS, FAMILIES))
def _(spark, d):
    return pareto.prune_families(_daily(spark, d)).select("journey_id")


@query("par_08_partition_families", sql("SELECT dep AS departure, arr AS arrival, CAST(v AS INTEGER) AS vehicles, a AS from_stop, b AS to_stop, count(*) AS leaves, CAST(min(jid) AS INTEGER) AS first_journey FROM jn GROUP BY dep, arr, v, a, b", WEEKS, FAMILIES))
def _(spark, d):
    return pareto.partition_families(_daily(spark, d)).select("departure", "arrival", "vehicles", "from_stop", "to_stop", "leaves", "first_journey")


@query("jny_03_reverse", sql("SELECT CAST(jid AS INTEGER) AS journey_id, string_agg(conn_id, ',' ORDER BY dep_time DESC, conn_id DESC) AS legs FROM wk GROUP BY jid", WEEKS))
def _(spark, d):
    return week_journeys(spark, d).select("journey_id", F.array_join(F.transform(journeys.reverse(F.col("legs")), lambda x: x["conn_id"]), ",").alias("legs"))


@query("jny_04_summarize", sql("SELECT CAST(jid AS INTEGER) AS journey_id, trip_id, arg_min(dep_stop, dep_time) AS from_stop, arg_max(arr_stop, dep_time) AS to_stop, min(dep_time) AS dep, max(arr_time) AS arr FROM wk GROUP BY jid, trip_id", WEEKS))
def _(spark, d):
    return journeys.summarize(week_journeys(spark, d)).select("journey_id", "trip_id", "from_stop", "to_stop", "dep", "arr")


@query("jny_05_legs", sql("SELECT CAST(jid AS INTEGER) AS journey_id, CAST(row_number() OVER (PARTITION BY jid ORDER BY dep_time, conn_id) - 1 AS INTEGER) AS pos, conn_id FROM wk", WEEKS))
def _(spark, d):
    return journeys.legs_of(week_journeys(spark, d)).select("journey_id", "pos", "conn_id")


@query("jny_06_count_leaves", sql("SELECT CAST(0 AS INTEGER) AS query_id, dep AS departure, arr AS arrival, CAST(v AS INTEGER) AS vehicles, count(*) AS leaves FROM jn GROUP BY dep, arr, v", WEEKS, FAMILIES))
def _(spark, d):
    return journeys.count_leaves(_daily(spark, d))


@query("jny_07_measure_with", sql("SELECT CAST(jid AS INTEGER) AS journey_id, max(travel_time) AS longest FROM wk GROUP BY jid", WEEKS))
def _(spark, d):
    longest = journeys.fold(F.col("legs"), F.lit(0).cast("long"), lambda acc, x: F.greatest(acc, x["arr"] - x["dep"]), lambda acc: acc)
    return week_journeys(spark, d).select("journey_id", longest.cast("int").alias("longest"))


@query("jny_09_accessors", sql("SELECT CAST(jid AS INTEGER) AS journey_id, arg_max(trip_id, dep_time) AS last_trip, min(dep_time) AS departure, max(arr_time) AS arrival FROM wk GROUP BY jid", WEEKS))
def _(spark, d):
    return week_journeys(spark, d).select("journey_id", journeys.last_trip_id(F.col("legs")).alias("last_trip"), journeys.departure(F.col("legs")).alias("departure"), journeys.arrival(F.col("legs")).alias("arrival"))


@query("jny_10_loop_check", sql("SELECT CAST(jid AS INTEGER) AS journey_id, 1 + count(*) > count(DISTINCT s) AS loop FROM (SELECT jid, unnest(CASE WHEN n = 1 THEN [dep_stop, arr_stop] ELSE [arr_stop] END) AS s, n FROM (SELECT *, row_number() OVER (PARTITION BY jid ORDER BY dep_time, conn_id) AS n FROM wk) o) u GROUP BY jid".replace("1 + count(*)", "count(*)"), WEEKS))
def _(spark, d):
    return week_journeys(spark, d).select("journey_id", journeys.has_loop(F.col("legs")).alias("loop"))


# --- 2.5 aggregations --------------------------------------------------------------------------------------------------

SEQ = "sq AS MATERIALIZED (SELECT trip_id, concat(arg_min(dep_stop, dep_time), '>', string_agg(arr_stop, '>' ORDER BY dep_time, conn_id)) AS route, count(*) + 1 AS n FROM c GROUP BY trip_id)"


@query("agg_01_route_merge", sql("SELECT route, CAST(n AS INTEGER) AS n_stops, count(*) AS n_trips, min(trip_id) AS first_trip FROM sq GROUP BY route, n", SEQ))
def _(spark, d):
    return sinks.routes_table(snapshot(spark, d))


@query("agg_01_routes_of_trips", sql("SELECT trip_id, route FROM sq", SEQ))
def _(spark, d):
    return sinks.routes_of_trips(snapshot(spark, d))


@query("agg_02_edge_stats", sql("SELECT dep_stop, arr_stop, count(DISTINCT operator_id) AS n_operators, count(DISTINCT route_type) AS n_route_types, count(DISTINCT route) AS n_routes FROM c JOIN tr USING (trip_id) GROUP BY dep_stop, arr_stop"))
def _(spark, d):
    return aggregates.edge_stats(snapshot(spark, d))


@query("agg_03_stop_stats", sql("""SELECT s AS stop_id, count(DISTINCT route) AS n_routes, count(DISTINCT operator_id) AS n_operators, CAST(sum(1 - o) AS BIGINT) AS arrivals, CAST(sum(o) AS BIGINT) AS departures, count(DISTINCT CASE WHEN o = 1 THEN concat(dep_stop, arr_stop, route) END) AS route_departures,
 count(DISTINCT CASE WHEN o = 0 THEN concat(dep_stop, arr_stop, route) END) AS route_arrivals, count(*) AS movements FROM (SELECT dep_stop AS s, 1 AS o, * FROM c JOIN tr USING (trip_id) UNION ALL SELECT arr_stop, 0, * FROM c JOIN tr USING (trip_id)) u GROUP BY s"""))
def _(spark, d):
    return aggregates.stop_stats(snapshot(spark, d))


@query("agg_04_bbox", sql("SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM st"))
def _(spark, d):
    return geo.bounding_box(derive.stops(spark, d))


@query("agg_06_date_range", sql("SELECT min(dep_time) AS earliest, max(dep_time) AS latest FROM c"))
def _(spark, d):
    return aggregates.date_range(derive.connections(spark, d))


COUNTS = "SELECT 'operators' AS name, count(*) AS n FROM region UNION ALL SELECT 'stops', count(*) FROM st UNION ALL SELECT 'trips', count(*) FROM tr UNION ALL SELECT 'connections', count(*) FROM c"


@query("agg_07_counts", sql(COUNTS))
def _(spark, d):
    return aggregates.counts(snapshot(spark, d))


@query(
    "agg_08_relation_members",
    sql(
        "SELECT route, member, CAST(row_number() OVER (PARTITION BY route ORDER BY f.dep_time, f.conn_id, f.p, member) AS INTEGER) AS pos FROM (SELECT route, member, min({'dep_time': dep_time, 'conn_id': conn_id, 'p': p}) AS f FROM mm GROUP BY route, member) g",
        "hj AS (SELECT * FROM c JOIN tr USING (trip_id))",
        "mm AS (SELECT route, dep_time, conn_id, 0 AS p, concat('node:', dep_stop) AS member FROM hj UNION ALL SELECT route, dep_time, conn_id, 1, concat('way:', dep_stop, '>', arr_stop) FROM hj UNION ALL SELECT route, dep_time, conn_id, 2, concat('node:', arr_stop) FROM hj)",
    ),
)
def _(spark, d):
    return aggregates.relation_members(snapshot(spark, d))


@query("agg_09_shell_state", sql(f"SELECT n.name, n.n, CASE WHEN n.name = 'connections' THEN (SELECT min(dep_time) FROM c) END AS earliest, CASE WHEN n.name = 'connections' THEN (SELECT max(dep_time) FROM c) END AS latest FROM ({COUNTS}) n"))
def _(spark, d):
    return aggregates.shell_state(snapshot(spark, d))


@query("agg_10_attribute_keys", "SELECT * FROM (VALUES ('headsign'), ('route'), ('route_type')) v(key)")
def _(spark, d):
    return aggregates.attribute_keys(derive.trips(spark, d))


@query("agg_11_headsign_coverage", sql("SELECT count(headsign) AS found, count(*) - count(headsign) AS failed, count(*) AS total FROM tr"))
def _(spark, d):
    return aggregates.headsign_coverage(derive.trips(spark, d))


@query("agg_12_delayed_count", sql("SELECT count(*) AS delayed FROM c WHERE dep_delay > 0"))
def _(spark, d):
    return aggregates.delayed_count(derive.connections(spark, d))


# --- 2.6 geo, 2.7 walks ------------------------------------------------------------------------------------------------


@query("geo_01_distance", sql(f"SELECT a.stop_id, round({DIST}, 3) AS dist FROM st a JOIN st b ON b.stop_id = 'stop/12'"))
def _(spark, d):
    at = derive.stops(spark, d).where("stop_id = 'stop/12'").select(F.col("lon").alias("x"), F.col("lat").alias("y"))
    return derive.stops(spark, d).join(F.broadcast(at)).select("stop_id", F.round(geo.distance_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")), 3).alias("dist"))


@query("geo_02_move", sql("SELECT stop_id, round(lat - degrees(250.0 / 6371000.0), 9) AS north, round(lon + degrees(250.0 / 6371000.0 / cos(radians(lat))), 9) AS east FROM st"))
def _(spark, d):
    return derive.stops(spark, d).select("stop_id", F.round(geo.move_north(F.col("lat"), 250.0), 9).alias("north"), F.round(geo.move_east(F.col("lon"), F.col("lat"), 250.0), 9).alias("east"))


TILES = "SELECT stop_id, CAST(floor((lon + 180.0) / 360.0 * 16384) AS INTEGER) AS tile_x, CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 16384) AS INTEGER) AS tile_y FROM st"


@query("geo_03_tile_of", sql(TILES))
def _(spark, d):
    return geo.with_tile(derive.stops(spark, d)).select("stop_id", "tile_x", "tile_y")


@query("geo_04_tile_corner", sql(f"SELECT DISTINCT tile_x, tile_y, round(tile_x / 16384.0 * 360.0 - 180.0, 9) AS west, round(degrees(atan((exp(pi() * (1 - 2 * tile_y / 16384.0)) - exp(-pi() * (1 - 2 * tile_y / 16384.0))) / 2)), 9) AS north FROM ({TILES}) t"))
def _(spark, d):
    t = geo.with_tile(derive.stops(spark, d)).select("tile_x", "tile_y").distinct()
    west, north = geo.tile_north_west(F.col("tile_x"), F.col("tile_y"))
    return t.select("tile_x", "tile_y", F.round(west, 9).alias("west"), F.round(north, 9).alias("north"))


@query("geo_05_tile_index", sql(f"SELECT tile_x, tile_y, count(*) AS n FROM ({TILES}) t GROUP BY tile_x, tile_y"))
def _(spark, d):
    return geo.with_tile(derive.stops(spark, d)).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("geo_06_in_box", sql(f"SELECT stop_id FROM ({TILES}) t WHERE tile_x BETWEEN floor(183.001 / 360.0 * 16384) AND floor(183.006 / 360.0 * 16384) AND tile_y BETWEEN floor((1.0 - ln(tan(radians(51.007)) + 1.0 / cos(radians(51.007))) / pi()) / 2.0 * 16384) AND floor((1.0 - ln(tan(radians(51.001)) + 1.0 / cos(radians(51.001))) / pi()) / 2.0 * 16384)"))
def _(spark, d):
    return geo.in_box(derive.stops(spark, d), 3.001, 51.001, 3.006, 51.007).select("stop_id")


HERE = "here AS (SELECT 3.0031::DOUBLE AS lon, 51.0042::DOUBLE AS lat)"


@query("geo_07_in_range", sql(f"SELECT b.stop_id, round({DIST}, 3) AS dist FROM here a, st b WHERE {DIST} <= 600", HERE))
def _(spark, d):
    return geo.in_range(derive.stops(spark, d), 3.0031, 51.0042, 600.0).select("stop_id", F.round("dist", 3).alias("dist"))


@query("geo_08_find_closest", sql(f"SELECT b.stop_id, round({DIST}, 3) AS dist FROM here a, st b WHERE {DIST} <= 1000 ORDER BY {DIST}, b.stop_id LIMIT 1", HERE))
def _(spark, d):
    return geo.find_closest(derive.stops(spark, d), 3.0031, 51.0042).select("stop_id", F.round("dist", 3).alias("dist"))


@query("wlk_02_internal_transfer", sql("SELECT stop_id AS from_stop, stop_id AS to_stop, CAST(180 AS INTEGER) AS secs FROM st"))
def _(spark, d):
    return walks.footpaths(derive.stops(spark, d), walks.InternalTransfer())


@query("wlk_03_first_last_mile", sql(f"SELECT * FROM (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, CASE WHEN a.stop_id IN ('stop/0', 'stop/1') THEN CASE WHEN {DIST} <= 600 AND a.stop_id <> b.stop_id THEN CAST(floor(round(1.0 * {DIST}, 6)) AS INTEGER) END WHEN b.stop_id = 'stop/12' THEN CASE WHEN a.stop_id = b.stop_id THEN 60 END ELSE CASE WHEN {DIST} <= 300 AND a.stop_id <> b.stop_id THEN CAST(floor(round(1.4 * {DIST}, 6)) AS INTEGER) END END AS secs FROM st a, st b) x WHERE secs IS NOT NULL"))
def _(spark, d):
    policy = walks.FirstLastMile(walks.CrowFlight(300.0), walks.CrowFlight(600.0, 1.0), walks.InternalTransfer(60), ("stop/0", "stop/1"), ("stop/12",))
    return walks.footpaths(derive.stops(spark, d), policy)


REACHED = f"re AS (SELECT arr_stop AS stop, min(arr_time) AS arrival FROM w WHERE arr_k < 5 GROUP BY arr_stop)"


@query("wlk_06_walk_away", sql(f"SELECT to_stop AS stop, min(arrival + secs) AS arrival FROM re JOIN fp ON fp.from_stop = re.stop WHERE arrival + secs <= {END} GROUP BY to_stop", FOOT, WINDOWED, REACHED))
def _(spark, d):
    stops = derive.stops(spark, d)
    w = rounds.in_window(derive.connections(spark, d), START, END)
    reached = w.where(F.col("arr_stop").isin(*[f"stop/{k}" for k in range(5)])).groupBy(F.col("arr_stop").alias("stop")).agg(F.min("arr_time").alias("arrival"))
    return walks.walk_away(reached, walks.footpaths(stops, walks.CrowFlight(METRES)), END)


@query("wlk_06_walk_towards", sql(f"SELECT from_stop AS stop, max(departure - secs) AS departure FROM (SELECT dep_stop AS stop, max(dep_time) AS departure FROM w WHERE dep_k < 5 GROUP BY dep_stop) re JOIN fp ON fp.to_stop = re.stop WHERE departure - secs >= {START} GROUP BY from_stop", FOOT, WINDOWED))
def _(spark, d):
    stops = derive.stops(spark, d)
    w = rounds.in_window(derive.connections(spark, d), START, END)
    reaching = w.where(F.col("dep_stop").isin(*[f"stop/{k}" for k in range(5)])).groupBy(F.col("dep_stop").alias("stop")).agg(F.max("dep_time").alias("departure"))
    return walks.walk_towards(reaching, walks.footpaths(stops, walks.CrowFlight(METRES)), START)


@query("wlk_01_crow_flight", sql(f"SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, CAST(floor(round(0.8 * {DIST}, 6)) AS INTEGER) AS secs FROM st a, st b WHERE a.stop_id <> b.stop_id AND {DIST} <= 400.0"))
def _(spark, d):
    return walks.footpaths(derive.stops(spark, d), walks.CrowFlight(400.0, 0.8))


# --- 2.8 sets, order, validation ---------------------------------------------------------------------------------------


def _halves(spark: SparkSession, d: str) -> tuple[Snapshot, Snapshot]:
    snap = snapshot(spark, d)
    a = filters.copy(snap, keep_connection=F.col("dep_time") < START)
    b = filters.copy(snap, keep_connection=F.col("dep_time") >= START - 86400)
    return a, b.with_tables(connections=b.connections.withColumn("travel_time", F.lit(1)), stops=b.stops).with_tables()


@query("set_01_merge", sql(f"SELECT conn_id, CAST(CASE WHEN dep_time < {START} THEN travel_time ELSE 1 END AS INTEGER) AS travel_time FROM c"))
def _(spark, d):
    a, b = _halves(spark, d)
    from dataclasses import replace

    return sets.merge([replace(a, global_id="a"), replace(b, global_id="b")]).connections.select("conn_id", "travel_time")


@query("set_02_merged_scan", sql("SELECT conn_id, CAST(source AS INTEGER) AS source_id, row_number() OVER (ORDER BY dep_time, source, conn_id) AS n FROM (SELECT *, mode % 2 AS source FROM c) u"))
def _(spark, d):
    own = derive.connections(spark, d)
    both = sets.merged_scan([own.where("mode % 2 = 0"), own.where("mode % 2 = 1")])
    return sets.numbered(both, "dep_time", ["dep_time", "source_id", "conn_id"], "n").select("conn_id", "source_id", F.col("n").cast("long").alias("n"))


@query("set_04_upsert", sql("SELECT conn_id, CASE WHEN event_id % 5 <> 0 THEN dep_time + 60 * (event_id % 5) ELSE dep_time END AS dep_time FROM c"))
def _(spark, d):
    own = derive.connections(spark, d)
    late = 60 * (F.substring_index("conn_id", "/", -1).cast("long") % 5)
    older = own.withColumns({"dep_time": F.lit(1).cast("bigint"), "version": F.lit(1)})
    newer = own.withColumns({"dep_time": F.col("dep_time") + late, "version": F.lit(2)})
    return sets.upsert(own, older.unionByName(newer).where(late != 0), "conn_id").select("conn_id", "dep_time")


LOADED = "SELECT DISTINCT CAST(l_orderkey * 1000 AS BIGINT) AS s, CAST(l_orderkey * 1000 + l_quantity * 60 AS BIGINT) AS e FROM lineitem"
ISLANDS = f"ld AS MATERIALIZED ({LOADED}), isl AS MATERIALIZED (SELECT min(s) AS start_time, max(e) AS end_time FROM (SELECT *, sum(fresh) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ld) x) y GROUP BY g)"


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 1000
    return derive.table(spark, d, "lineitem").select(k.cast("bigint").alias("start_time"), (k + F.col("l_quantity") * 60).cast("bigint").alias("end_time"))


@query("set_05_window_difference", sql("SELECT g.e AS start_time, g.nxt AS end_time FROM (SELECT e, lead(s) OVER (ORDER BY s, e) AS nxt FROM (SELECT greatest(start_time, 100000) AS s, least(end_time, 900000000) AS e FROM isl WHERE end_time > 100000 AND start_time < 900000000 UNION ALL SELECT 0, 100000 UNION ALL SELECT 900000000, 900000000) u) g WHERE g.nxt > g.e", ISLANDS))
def _(spark, d):
    return sets.window_difference(_loaded(spark, d), 100000, 900000000)


@query("set_06_window_union", sql("SELECT start_time, end_time FROM isl", ISLANDS))
def _(spark, d):
    return sets.window_union(_loaded(spark, d))


@query("srt_01_connection_order", sql("SELECT conn_id, dep_time, row_number() OVER (ORDER BY dep_time, trip_id, conn_id) - 1 AS seq FROM c"))
def _(spark, d):
    return sets.sorted_connections(derive.connections(spark, d))


@query("src_23_connection_scan", sql(f"SELECT conn_id, dep_time FROM c WHERE dep_time >= {START}"))
def _(spark, d):
    return filters.scan_from(derive.connections(spark, d), START).select("conn_id", "dep_time")


@query("src_23_backward_scan", sql(f"SELECT conn_id, dep_time FROM c WHERE dep_time <= {START}"))
def _(spark, d):
    return filters.scan_from(derive.connections(spark, d), START, backward=True).select("conn_id", "dep_time")


@query("win_01_previous_hop", sql("SELECT conn_id, lag(arr_stop) OVER w AS prev_stop, lag(arr_time) OVER w AS prev_arr FROM c WINDOW w AS (PARTITION BY trip_id ORDER BY dep_time, conn_id)"))
def _(spark, d):
    return validate.with_previous(derive.connections(spark, d)).select("conn_id", "prev_stop", "prev_arr")


FAULTS = f"""pv AS MATERIALIZED (SELECT x.*, {DIST} AS dist, x.arr_time - x.dep_time AS t FROM (SELECT *, lag(conn_id) OVER w AS pc, lag(arr_stop) OVER w AS ps, lag(arr_time) OVER w AS pa FROM raw WINDOW w AS (PARTITION BY trip_id ORDER BY dep_time, conn_id)) x JOIN st a ON a.stop_id = dep_stop JOIN st b ON b.stop_id = arr_stop WHERE pc IS NOT NULL),
ft AS MATERIALIZED (SELECT conn_id, 'jump' AS type, true AS hard FROM pv WHERE ps <> dep_stop UNION ALL SELECT conn_id, 'stall', true FROM pv WHERE dep_stop = arr_stop UNION ALL SELECT conn_id, 'timetravel', true FROM pv WHERE pa > dep_time
UNION ALL SELECT conn_id, 'teleportation', false FROM pv WHERE dep_stop <> arr_stop AND t = 0 UNION ALL SELECT conn_id, 'closeby', true FROM pv WHERE dep_stop <> arr_stop AND t <> 0 AND dist < 50 UNION ALL SELECT conn_id, 'reverse', true FROM pv WHERE dep_stop <> arr_stop AND dist >= 50 AND t < 0
UNION ALL SELECT conn_id, 'slow', false FROM pv WHERE dep_stop <> arr_stop AND dist >= 50 AND t > 0 AND dist / t * 3.6 <= 1 UNION ALL SELECT conn_id, 'fast', false FROM pv WHERE dep_stop <> arr_stop AND dist >= 50 AND t > 0 AND dist / t * 3.6 > CASE WHEN dist < 10000 THEN 100 WHEN dist < 50000 THEN 150 WHEN dist < 100000 THEN 200 END
UNION ALL SELECT conn_id, 'world-record', true FROM pv WHERE dep_stop <> arr_stop AND dist >= 50 AND t > 0 AND dist / t * 3.6 >= 574)"""
#: Faults are planted: some arrivals move before, onto or shortly after the departure, and some hops leave from another stop.
RAW = """raw AS MATERIALIZED (SELECT conn_id, CASE WHEN event_id % 17 = 0 THEN 'stop/3' ELSE dep_stop END AS dep_stop, arr_stop, dep_time, dep_time + CASE event_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN -30 ELSE arr_time - dep_time END AS arr_time, trip_id FROM r WHERE arr_time IS NOT NULL)"""


def faulty(spark: SparkSession, d: str) -> Snapshot:
    own = derive.raw_connections(derive.hops(spark, d)).where("arr_time IS NOT NULL")
    e = F.substring_index("conn_id", "/", -1).cast("long")
    own = own.withColumn("dep_stop", F.when(e % 17 == 0, "stop/3").otherwise(F.col("dep_stop")))
    shift = F.when(e % 11 == 0, 0).when(e % 11 == 1, 5).when(e % 11 == 2, -30).otherwise(F.col("arr_time") - F.col("dep_time"))
    return derive.snapshot(spark, d).with_tables(connections=own.withColumn("arr_time", F.col("dep_time") + shift))


@query("val_01_to_08_faults", sql("SELECT conn_id, type, hard AS is_hard_error FROM ft", RAW, FAULTS))
def _(spark, d):
    return validate.validate(faulty(spark, d)).select("conn_id", "type", "is_hard_error")


RELAXED = """SELECT conn_id, type, hard AS is_hard_error FROM ft WHERE type IN ('jump', 'stall', 'timetravel') UNION ALL SELECT conn_id, 'teleportation', false FROM pv WHERE dep_stop <> arr_stop AND t = 0 AND dist >= 10000
UNION ALL SELECT conn_id, 'closeby', true FROM pv WHERE dep_stop <> arr_stop AND t <> 0 AND dist < 1 UNION ALL SELECT conn_id, 'reverse', true FROM pv WHERE dep_stop <> arr_stop AND dist >= 1 AND t < 0
UNION ALL SELECT conn_id, 'slow', false FROM pv WHERE dep_stop <> arr_stop AND dist >= 10000 AND t > 0 AND dist / t * 3.6 <= 1 UNION ALL SELECT conn_id, 'fast', false FROM pv WHERE dist >= 10000 AND t > 0 AND dist / t * 3.6 > CASE WHEN dist < 50000 THEN 150 WHEN dist < 100000 THEN 200 END
UNION ALL SELECT conn_id, 'world-record', true FROM pv WHERE dep_stop <> arr_stop AND dist >= 1 AND t > 0 AND dist / t * 3.6 >= 574"""


@query("val_01_to_08_relaxed", sql(RELAXED, RAW, FAULTS))
def _(spark, d):
    return validate.validate(faulty(spark, d), relax=True).select("conn_id", "type", "is_hard_error")


@query("agg_05_validate_histogram", sql("SELECT type, count(*) AS n, bool_or(hard) AS hard FROM ft GROUP BY type", RAW, FAULTS))
def _(spark, d):
    return aggregates.validation_histogram(validate.validate(faulty(spark, d)))


@query("lim_01_cutoff", sql("SELECT conn_id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY conn_id) AS n FROM ft) x WHERE n <= 10", RAW, FAULTS))
def _(spark, d):
    return validate.cutoff(validate.validate(faulty(spark, d))).select("conn_id", "type")


@query("val_00_model_errors", sql("SELECT conn_id FROM raw WHERE arr_time < dep_time OR arr_time <> dep_time + (SELECT travel_time FROM r WHERE r.conn_id = raw.conn_id)", RAW))
def _(spark, d):
    return connection_errors(faulty(spark, d).connections).select("conn_id")


# --- 2.1 feeds and runs on derived tables ------------------------------------------------------------------------------

FEED = """tt AS MATERIALIZED (SELECT l_orderkey AS o, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem),
hp AS MATERIALIZED (SELECT o, s AS a, lead(s) OVER w AS b, seq, 21600 + (o % 720) * 60 + seq * 600 AS secs, seq % 4 = 3 AS no_on, lead(seq % 5 = 4) OVER w AS no_off FROM tt WINDOW w AS (PARTITION BY o ORDER BY seq)),
dy AS MATERIALIZED (SELECT v.s AS service, CAST(DATE '2020-01-06' + CAST(v.s AS INTEGER) AS DATE) AS day FROM range(7) v(s) WHERE NOT (v.s = 1) UNION ALL SELECT 0, DATE '2020-01-07'),
fd AS MATERIALIZED (SELECT concat('https://example.org/connection/', o, '/', strftime(day, '%Y%m%d'), '/', seq) AS conn_id, concat('https://example.org/stop/', a) AS dep_stop, concat('https://example.org/stop/', b) AS arr_stop, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) + secs AS dep_time, CAST(600 AS INTEGER) AS travel_time,
 CASE WHEN no_on AND no_off THEN 3 WHEN no_off THEN 1 WHEN no_on THEN 2 ELSE 0 END AS mode, concat('https://example.org/trip/', o, '/', strftime(day, '%Y%m%d')) AS trip_id, o, a, b FROM hp JOIN dy ON dy.service = o % 7 WHERE b IS NOT NULL AND o IN (SELECT o_orderkey FROM orders))"""


def feed_snapshot(spark: SparkSession, d: str) -> Snapshot:
    return gtfs.load(derive.gtfs_feed(spark, d), FIRST, LAST)


@query("src_01_gtfs_load", sql(f"SELECT {CONN} FROM fd", FEED))
def _(spark, d):
    return conns(feed_snapshot(spark, d).connections)


@query("src_02_gtfs_agencies", "SELECT 'https://example.org/' AS operator_id, min_by(n_name, CAST(n_nationkey AS VARCHAR)) AS name FROM nation")
def _(spark, d):
    return feed_snapshot(spark, d).operators.select("operator_id", attribute("name").alias("name"))


@query("src_03_gtfs_stops", sql("SELECT concat('https://example.org/stop/', s_suppkey) AS stop_id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT a FROM fd UNION ALL SELECT b FROM fd)", FEED))
def _(spark, d):
    return feed_snapshot(spark, d).stops.select("stop_id", attribute("name").alias("name"))


@query("src_04_gtfs_calendar", "SELECT CAST(v.s AS VARCHAR) AS service_id, CAST(DATE '2020-01-06' + CAST(v.s AS INTEGER) AS DATE) AS day FROM range(7) v(s) WHERE NOT (v.s = 1) UNION ALL SELECT '0', DATE '2020-01-07'")
def _(spark, d):
    feed = derive.gtfs_feed(spark, d)
    return gtfs.active_days(feed["calendar"], feed["calendar_dates"], FIRST, LAST)


@query("src_05_gtfs_trips", sql("SELECT DISTINCT fd.trip_id, 'https://example.org/' AS operator_id, CAST(o_custkey AS VARCHAR) AS route, c_name AS shortname FROM fd JOIN orders ON o_orderkey = fd.o LEFT JOIN customer ON c_custkey = o_custkey", FEED))
def _(spark, d):
    return feed_snapshot(spark, d).trips.select("trip_id", "operator_id", attribute("route").alias("route"), attribute("shortname").alias("shortname"))


@query("src_06_gtfs_connection_modes", sql("SELECT mode, count(*) AS n FROM fd GROUP BY mode", FEED))
def _(spark, d):
    return feed_snapshot(spark, d).connections.groupBy(F.col("mode").cast("int").alias("mode")).agg(F.count("*").alias("n"))


@query("src_07_gtfs_routes", "SELECT CAST(c_custkey AS VARCHAR) AS route_id, c_name AS shortname FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    feed = derive.gtfs_feed(spark, d)
    used = feed["trips"].select("route_id").distinct()
    return feed["routes"].join(used, "route_id").select("route_id", F.col("route_short_name").alias("shortname"))


@query("src_08_gtfs_settings", "SELECT concat('https://example.org/stop/', s_suppkey) AS stop_id FROM supplier")
def _(spark, d):
    return gtfs.load(derive.gtfs_feed(spark, d), FIRST, LAST, gtfs.Settings(add_unused_stops=True)).stops.select("stop_id")


def _routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    region, nation = derive.table(spark, d, "region"), derive.table(spark, d, "nation")
    k = F.col("r_regionkey")
    found = region.select(k.cast("long").alias("route_id"), F.col("r_name").alias("name"), (k % 2 == 0).alias("round_trip"), F.lit(3000).cast("long").alias("duration"), (600 + 300 * k).cast("long").alias("interval"))
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    places = nation.select(F.col("n_regionkey").cast("long").alias("route_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("n_nationkey").cast("long").alias("node"))
    return found, places


@query(
    "src_20_osm_runs",
    f"""WITH p AS (SELECT n_regionkey AS r, n_nationkey AS a, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, count(*) OVER (PARTITION BY n_regionkey) AS n, first_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS l FROM nation),
 h AS (SELECT *, coalesce(l, CASE WHEN r % 2 = 0 THEN f END) AS b, 600 + 300 * r AS i, 3000 // n AS took, CASE WHEN r % 2 = 0 THEN n ELSE n - 1 END AS hops FROM p),
 e AS (SELECT *, {START} + g.g * i AS leaves, g.g AS run FROM h, range(0, 37) g(g) WHERE b IS NOT NULL AND b <> a AND {START} + g.g * i <= {START} + 21600)
 SELECT concat('https://www.openstreetmap.org/relation/', r, '/', leaves, '/', pos) AS conn_id, concat('https://www.openstreetmap.org/node/', a) AS dep_stop, concat('https://www.openstreetmap.org/node/', b) AS arr_stop, CAST(leaves + pos * took AS BIGINT) AS dep_time, CAST(took AS INTEGER) AS travel_time,
 CASE WHEN r % 2 = 0 OR hops = 1 THEN 0 WHEN pos = 0 THEN 1 WHEN pos = hops - 1 THEN 2 ELSE 0 END AS mode, concat('https://www.openstreetmap.org/relation/', r, '/vehicle/', CASE WHEN r % 2 = 0 THEN run % CAST(ceil(3000.0 / i) AS BIGINT) ELSE run END) AS trip_id FROM e""",
)
def _(spark, d):
    found, places = _routes(spark, d)
    return conns(osm.runs(found, places, START, START + 21600))


@query("src_25_floating_stops", "SELECT concat('https://www.openstreetmap.org/#map=16/', 51 + n_nationkey * 0.001, '/', 3 + n_nationkey * 0.002) AS stop_id, round(3 + n_nationkey * 0.002, 6)::DOUBLE AS lon, round(51 + n_nationkey * 0.001, 6)::DOUBLE AS lat FROM nation")
def _(spark, d):
    n = F.col("n_nationkey")
    at = lambda base, step: (F.lit(base).cast("decimal(10,3)") + n.cast("decimal(10,0)") * F.lit(step).cast("decimal(10,3)")).cast("decimal(10,3)")
    urls = derive.table(spark, d, "nation").select(F.concat(F.lit("https://www.openstreetmap.org/#map=16/"), at("51", "0.001"), F.lit("/"), at("3", "0.002")).alias("url"))
    return osm.floating_stops(urls).select("stop_id", "lon", "lat")


@query("prs_02_duration", "SELECT t AS text, s AS seconds FROM (VALUES ('1:30', 5400), ('0:05:30', 330), ('2 hours', 7200), ('1h', 3600), ('45', 2700), ('15 min', 900), ('soon', NULL)) v(t, s)")
def _(spark, d):
    rows = spark.createDataFrame([(t,) for t in ("1:30", "0:05:30", "2 hours", "1h", "45", "15 min", "soon")], "text string")
    return rows.select("text", parsers.duration_seconds(F.col("text")).cast("int").alias("seconds"))


FLAGS = "fl AS (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS x FROM events)"


@query("src_12_lc_mode", sql("SELECT event_id, CASE WHEN a AND b THEN 0 WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END + CASE WHEN x THEN 4 ELSE 0 END AS mode FROM fl", FLAGS))
def _(spark, d):
    e = F.col("event_id")
    return derive.table(spark, d, "events").select("event_id", lc.lc_mode(e % 2 == 0, e % 3 == 0, e % 5 == 0).cast("int").alias("mode"))


@query("src_15_lc_timetable_uri", sql("SELECT conn_id, concat('http://x/c?departureTime=', strftime(make_timestamp((dep_time - dep_time % 60) * 1000000), '%Y-%m-%dT%H:%M:%S'), '.000Z') AS uri, dep_time - dep_time % 60 AS minute FROM c"))
def _(spark, d):
    uri = lc.page_uri_column("http://x/c", F.timestamp_seconds("dep_time"))
    return derive.connections(spark, d).select("conn_id", uri.alias("uri")).withColumn("minute", F.unix_timestamp(lc.page_time(F.col("uri"))))


@query(
    "src_19_osm_stop_positions",
    """WITH m AS (SELECT n_regionkey AS route_id, n_nationkey AS node, n_nationkey AS ord, 3.0 + (n_nationkey % 5) * 0.004 AS lon, 51.0 + floor(n_nationkey / 5) * 0.003 AS lat, n_nationkey % 3 <> 0 AS stop FROM nation)
 SELECT route_id, node, CAST(row_number() OVER (PARTITION BY route_id ORDER BY stop DESC, node) - 1 AS INTEGER) AS pos FROM m""",
)
def _(spark, d):
    # Nations are stops, or platforms far from any stop where their key is a multiple of three; a platform 11 m beside each stop belongs to it.
    n = F.col("n_nationkey").cast("long")
    lon, lat = 3.0 + (n % 5) * 0.004, 51.0 + F.floor(n / 5) * 0.003
    none = F.expr(f"cast(array() as {osm.TAGS})")
    own = derive.table(spark, d, "nation")
    nodes = own.select(n.alias("_id"), lat.alias("_lat"), lon.alias("_lon"), none.alias("tag")).unionByName(own.where(n % 3 != 0).select((n + 1000).alias("_id"), (lat + 0.0001).alias("_lat"), lon.alias("_lon"), none.alias("tag")))
    role = F.when((F.col("node") >= 1000) | (F.col("node") % 3 == 0), "platform").otherwise("stop")
    members = own.select(F.col("n_regionkey").cast("long").alias("route_id"), F.explode(F.array(n, n + 1000)).alias("node")).where("NOT (node >= 1000 AND node % 1000 % 3 = 0)")
    found = members.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("node", role.alias("role")))).alias("m"))
    found = found.select("route_id", F.transform("m", lambda x: F.struct(F.lit("node").alias("_type"), x["node"].alias("_ref"), x["role"].alias("_role"))).alias("members"))
    return osm.stop_positions(found, nodes).select("route_id", "node", "pos")


@query("src_24_table_scan", sql("SELECT trip_id, operator_id FROM tr"))
def _(spark, d):
    return derive.trips(spark, d).select("trip_id", "operator_id")


@query("set_03_table_aggregator", sql("SELECT stop_id, CAST(CASE WHEN lat < 51.004 THEN 0 ELSE 1 END AS INTEGER) AS source_id FROM st"))
def _(spark, d):
    own = derive.stops(spark, d)
    return sets.first_match([own.where("lat < 51.004"), own], "stop_id").select("stop_id", "source_id")


@query("fn_dates", sql("SELECT conn_id, epoch(make_timestamp(dep_time * 1000000) AT TIME ZONE 'Europe/Brussels')::BIGINT AS utc, strftime(make_timestamp(dep_time * 1000000), '%Y-%m-%d_%H') AS hour FROM c"))
def _(spark, d):
    local = F.timestamp_seconds("dep_time")
    return derive.connections(spark, d).select("conn_id", F.unix_timestamp(parsers.local_to_utc(local, "Europe/Brussels")).alias("utc"), F.date_format(local, "yyyy-MM-dd_HH").alias("hour"))


@query("fn_file_name", "SELECT p_partkey AS k, regexp_replace(concat(p_name, '/', p_type, ':', p_size, '?'), '[\\\\/:*?\"<>|]', '_', 'g') AS name FROM part")
def _(spark, d):
    return derive.table(spark, d, "part").select(F.col("p_partkey").alias("k"), parsers.file_name(F.concat("p_name", F.lit("/"), "p_type", F.lit(":"), "p_size", F.lit("?"))).alias("name"))


# --- 2.2 sinks as tables, 2.9 refresh ----------------------------------------------------------------------------------


@query("snk_02_stops_table", sql("SELECT stop_id AS \"globalId\", lat AS \"Latitude\", lon AS \"Longitude\", name FROM st"))
def _(spark, d):
    return sinks.stops_table(snapshot(spark, d))


@query("snk_03_trips_table", sql("SELECT trip_id AS \"GlobalId\", headsign, route, route_type FROM tr"))
def _(spark, d):
    return sinks.trips_table(snapshot(spark, d))


@query("snk_04_connections_table", sql("SELECT c.conn_id, c.dep_stop, a.name AS dep_name, strftime(make_timestamp(c.dep_time * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS departure, c.arr_stop, b.name AS arr_name, strftime(make_timestamp(c.arr_time * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS arrival, c.travel_time, c.mode, c.trip_id, tr.headsign FROM c JOIN st a ON a.stop_id = c.dep_stop JOIN st b ON b.stop_id = c.arr_stop JOIN tr ON tr.trip_id = c.trip_id"))
def _(spark, d):
    return sinks.connections_table(snapshot(spark, d)).withColumn("mode", F.col("mode").cast("int"))


def _tiles_sql(low: int, high: int) -> str:
    """Stops in their tiles; lines in those they cross: per column of tiles, the rows between where the line enters and leaves it."""
    at = lambda p: f"({p}_lon + 180.0) / 360.0 * n AS {p}_x, (1.0 - ln(tan(radians({p}_lat)) + 1.0 / cos(radians({p}_lat))) / pi()) / 2.0 * n AS {p}_y"
    y = lambda edge: f"CASE WHEN b_x = a_x THEN NULL ELSE a_y + ({edge} - a_x) / (b_x - a_x) * (b_y - a_y) END"
    return sql(
        """SELECT DISTINCT 'routes' AS layer, zoom, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, feature, properties FROM (SELECT *, unnest(range(CAST(floor(least(y0, y1)) AS BIGINT), CAST(floor(greatest(y0, y1)) AS BIGINT) + 1)) AS y FROM cols) q
UNION ALL SELECT 'stops', zoom, CAST(floor(a_x) AS INTEGER), CAST(floor(a_y) AS INTEGER), stop_id, properties FROM pt""",
        f"z AS (SELECT CAST(zoom AS INTEGER) AS zoom, CAST(pow(2, zoom) AS DOUBLE) AS n FROM range({low}, {high + 1}) r(zoom))",
        "es AS (SELECT dep_stop, arr_stop, count(DISTINCT operator_id) AS n_operators, count(DISTINCT route_type) AS n_route_types, count(DISTINCT route) AS n_routes FROM c JOIN tr USING (trip_id) GROUP BY dep_stop, arr_stop)",
        f"ln AS MATERIALIZED (SELECT zoom, concat(dep_stop, '>', arr_stop) AS feature, concat('{{\"n_operators\":', n_operators, ',\"n_route_types\":', n_route_types, ',\"n_routes\":', n_routes, '}}') AS properties, {at('a')}, {at('b')} FROM (SELECT es.*, a.lon AS a_lon, a.lat AS a_lat, b.lon AS b_lon, b.lat AS b_lat FROM es JOIN st a ON a.stop_id = dep_stop JOIN st b ON b.stop_id = arr_stop) e, z)",
        f"cols AS (SELECT zoom, feature, properties, x, coalesce(CASE WHEN x <= least(a_x, b_x) THEN CASE WHEN a_x <= b_x THEN a_y ELSE b_y END ELSE {y('x')} END, a_y) AS y0, coalesce(CASE WHEN x + 1 >= greatest(a_x, b_x) THEN CASE WHEN a_x <= b_x THEN b_y ELSE a_y END ELSE {y('x + 1')} END, b_y) AS y1 FROM (SELECT *, unnest(range(CAST(floor(least(a_x, b_x)) AS BIGINT), CAST(floor(greatest(a_x, b_x)) AS BIGINT) + 1)) AS x FROM ln) l)",
        "ss AS (SELECT s AS stop_id, count(DISTINCT route) AS n_routes, count(DISTINCT operator_id) AS n_operators, CAST(sum(1 - o) AS BIGINT) AS arrivals, CAST(sum(o) AS BIGINT) AS departures FROM (SELECT dep_stop AS s, 1 AS o, * FROM c JOIN tr USING (trip_id) UNION ALL SELECT arr_stop, 0, * FROM c JOIN tr USING (trip_id)) u GROUP BY s)",
        f"pt AS MATERIALIZED (SELECT zoom, stop_id, concat('{{\"n_routes\":', n_routes, ',\"n_operators\":', n_operators, ',\"arrivals\":', arrivals, ',\"departures\":', departures, '}}') AS properties, {at('a')} FROM (SELECT ss.*, lon AS a_lon, lat AS a_lat FROM ss JOIN st USING (stop_id)) s, z)",
    )


@query("snk_06_tile_features", _tiles_sql(10, 14))
def _(spark, d):
    return sinks.tile_features(snapshot(spark, d), 10, 14)


@query("snk_07_map_relations", ORACLES["agg_08_relation_members"].replace("SELECT route, member, CAST(row_number()", "SELECT g.route, CASE k.t WHEN '0' THEN 'tram' WHEN '1' THEN 'subway' WHEN '2' THEN 'train' ELSE 'bus' END AS tag, member, CAST(row_number()").replace("PARTITION BY route ORDER BY f.dep_time", "PARTITION BY g.route ORDER BY f.dep_time").replace(") g", ") g JOIN (SELECT route, min(route_type) AS t FROM tr GROUP BY route) k ON k.route = g.route"))
def _(spark, d):
    return sinks.map_relations(snapshot(spark, d))


@query("snk_08_geojson_journey", sql("""SELECT CAST(0 AS INTEGER) AS query_id, CAST(jid AS INTEGER) AS journey_id, concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[', string_agg(concat('[', CAST(lon AS VARCHAR), ',', CAST(lat AS VARCHAR), ']'), ',' ORDER BY pos), ']},"properties":{"stops":', count(*), '}}]}') AS geojson
 FROM (SELECT jid, -1 AS pos, arg_min(dep_stop, (dep_time, conn_id)) AS s FROM wk GROUP BY jid UNION ALL SELECT jid, row_number() OVER (PARTITION BY jid ORDER BY dep_time, conn_id) - 1, arr_stop FROM wk) p JOIN st ON st.stop_id = p.s GROUP BY jid""", WEEKS))
def _(spark, d):
    return journeys.to_geojson(week_journeys(spark, d), derive.stops(spark, d))


@query("snk_12_journey_to_string", sql("SELECT CAST(jid AS INTEGER) AS journey_id, string_agg(concat(strftime(make_timestamp(dep_time * 1000000), '%H:%M'), ' ', trip_id, ' ', dep_stop, ' -> ', strftime(make_timestamp(arr_time * 1000000), '%H:%M'), ' ', arr_stop), chr(10) ORDER BY dep_time, conn_id) AS itinerary FROM wk GROUP BY jid", WEEKS))
def _(spark, d):
    return journeys.to_text(week_journeys(spark, d)).select("journey_id", "itinerary")


@query("str_04_late_updates", sql("SELECT conn_id, dep_time + 60 * (event_id % 5) AS dep_time FROM c"))
def _(spark, d):
    own = derive.connections(spark, d)
    late = 60 * (F.substring_index("conn_id", "/", -1).cast("long") % 5)
    both = own.withColumn("version", F.lit(1)).unionByName(own.withColumns({"dep_time": F.col("dep_time") + late, "version": F.lit(2)}))
    return refresh.latest_versions(both).select("conn_id", "dep_time")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("str_04_stream_of_updates", ORACLES["str_04_late_updates"])
def _(spark, d):
    own = derive.connections(spark, d)
    late = 60 * (F.substring_index("conn_id", "/", -1).cast("long") % 5)
    arrived, store = _scratch(spark, "changes"), snapshots.Store(spark, _scratch(spark, "store"))
    own.withColumn("version", F.lit(1).cast("bigint")).unionByName(own.withColumns({"dep_time": F.col("dep_time") + late, "version": F.lit(2).cast("bigint")})).write.parquet(arrived)
    refresh.upsert_stream(refresh.connection_stream(spark, arrived), store, _scratch(spark, "progress")).awaitTermination()
    return store.latest().connections.select("conn_id", "dep_time")


#: Days from the start of the journeys' window.
DAY = 86400


@query("str_01_update_time_frame", sql(f"SELECT {CONN} FROM c WHERE (dep_time >= {START} AND dep_time < {START + DAY}) OR (dep_time >= {START + 3 * DAY} AND dep_time < {START + 4 * DAY})"))
def _(spark, d):
    # Of four days two are loaded: only the gaps are fetched.
    own = derive.connections(spark, d)
    load = lambda writer, a, b: writer.add("connections", own.where((F.col("dep_time") >= a) & (F.col("dep_time") < b)))
    updater = refresh.Updater(snapshots.Store(spark, _scratch(spark, "store")), load, [(START + DAY, START + 2 * DAY), (START + 2 * DAY - 500, START + 3 * DAY)])
    updater.update(START, START + 4 * DAY)
    return conns(updater.store.latest().connections)


@query("src_21_snapshot_round_trip", sql(f"SELECT {CONN} FROM c"))
def _(spark, d):
    path = _scratch(spark, "snapshot")
    snapshots.write(snapshot(spark, d), path)
    return conns(snapshots.read(spark, path).connections)


@query("cli_01_executor", sql(f"SELECT {CONN} FROM c WHERE dep_time >= {START} AND dep_time < {END} AND (dep_stop = 'stop/3' OR arr_stop = 'stop/3')"))
def _(spark, d):
    path = _scratch(spark, "snapshot")
    snapshots.write(snapshot(spark, d), path)
    words = ["--read-transit-db", path, "--select-stop", "stop/3", "--select-time", "start=2024-01-15", "duration=1day", "allow-empty=true", "--remove-unused"]
    return conns(cli.execute(cli.State(spark), cli.parse(words))[0].connections)


@query("snk_07_map_nodes", sql("SELECT concat('node:', stop_id) AS node, lon, lat, name FROM st"))
def _(spark, d):
    return sinks.map_nodes(snapshot(spark, d))


@query("snk_07_map_ways", sql("SELECT DISTINCT concat('way:', dep_stop, '>', arr_stop) AS way, concat('node:', dep_stop) AS from_node, concat('node:', arr_stop) AS to_node FROM c"))
def _(spark, d):
    return sinks.map_ways(snapshot(spark, d))


@query("snk_04_connections_human", sql("SELECT c.conn_id, a.name AS dep_name, strftime(make_timestamp(c.dep_time * 1000000), '%H:%M') AS departure, b.name AS arr_name, strftime(make_timestamp(c.arr_time * 1000000), '%H:%M') AS arrival, c.travel_time, tr.headsign, tr.route, c.mode FROM c JOIN st a ON a.stop_id = c.dep_stop JOIN st b ON b.stop_id = c.arr_stop JOIN tr ON tr.trip_id = c.trip_id"))
def _(spark, d):
    return sinks.connections_table(snapshot(spark, d), human=True).withColumn("mode", F.col("mode").cast("int"))


@query("jny_02_chain_special", sql("SELECT CAST(jid AS INTEGER) AS journey_id, max(arr_time) + 300 AS arrival, CAST(count(*) + 1 AS INTEGER) AS n FROM wk GROUP BY jid", WEEKS))
def _(spark, d):
    legs = journeys.chain_special(F.col("legs"), journeys.WALK, F.lit("stop/0"), F.lit(300))
    return week_journeys(spark, d).select("journey_id", journeys.arrival(legs).alias("arrival"), F.size(legs).alias("n"))


@query("jny_08_append", sql("SELECT CAST(jid AS INTEGER) AS journey_id, CAST(2 * count(*) AS INTEGER) AS n, min(dep_time) AS departure FROM wk GROUP BY jid", WEEKS))
def _(spark, d):
    legs = journeys.append(F.col("legs"), journeys.reverse(F.col("legs")))
    return week_journeys(spark, d).select("journey_id", F.size(legs).alias("n"), journeys.departure(legs).alias("departure"))


@query("str_departures_by_window", sql("SELECT dep_time - dep_time % 900 AS start_time, dep_stop, count(*) AS departures FROM c GROUP BY dep_time - dep_time % 900, dep_stop"))
def _(spark, d):
    return refresh.windowed_departures(derive.connections(spark, d))


from . import more_queries  # noqa: E402, F401 - adds its queries
