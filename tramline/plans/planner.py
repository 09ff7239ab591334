"""The fluent interface: choose a profile, stops and a window, then ask; and the same for tables of requests."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geo
from ..model import JOURNEYS, LEG, Snapshot, all_of, can_get_off, can_get_on
from ..operators import filters, journeys, sets, walks
from ..storage import stored
from . import kernel, rounds

#: Bytes of a window's connections and walks that go to the tasks whole; beyond it each family of requests gets those of use to it.
KERNEL_BYTES = 64 << 20
#: Tasks that requests to the same stops are spread over where legs of all journeys are spelled out.
SPREAD = 8
#: Journeys that none beats, without their legs.
FRONTIER = "query_id int, departure bigint, arrival bigint, vehicles int"


@dataclass(frozen=True)
class Profile:
    """How to travel: transfer seconds, walks, filters, and transfers allowed."""

    transfer: int = 180
    walks: walks.Generator = field(default_factory=walks.CrowFlight)
    connection_filter: Column | None = None
    max_transfers: int | None = None
    legacy_transfer: bool = False
    #: Whether a partial journey (departure, arrival, vehicles) may go on.
    journey_filter: Callable[[int, int, int], bool] | None = None


def epoch(t: int | datetime) -> int:
    """Seconds of a time in UTC; a time of another zone, or of none, is an error."""
    if isinstance(t, datetime):
        if t.tzinfo is None or t.utcoffset() != timezone.utc.utcoffset(None):
            raise ValueError("times must be in UTC")
        return int(t.timestamp())
    return int(t)


class InvalidRequest(ValueError):
    """A request without stops, with the same stop at both ends, or without a proper window."""


@dataclass(frozen=True)
class Planner:
    """Questions about one or more snapshots. Each method returns a new planner or the answer."""

    snapshots: Sequence[Snapshot] | Snapshot
    profile: Profile = field(default_factory=Profile)
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    start: int | None = None
    end: int | None = None
    paths: DataFrame | None = None
    filtered: bool = False

    @property
    def snapshot(self) -> Snapshot:
        own = self.snapshots
        return own if isinstance(own, Snapshot) else sets.merge(list(own)) if len(own) > 1 else own[0]

    @property
    def spark(self):
        return self.snapshot.connections.sparkSession

    def with_profile(self, profile: Profile) -> Planner:
        return replace(self, profile=profile)

    def with_stops(self, stops: DataFrame) -> Planner:
        return replace(self, snapshots=self.snapshot.with_tables(stops=stops))

    def with_extra_stops(self, stops: DataFrame) -> Planner:
        snap = self.snapshot
        return replace(self, snapshots=snap.with_tables(stops=snap.stops.unionByName(stops, allowMissingColumns=True)))

    def with_footpaths(self, paths: DataFrame | None = None) -> Planner:
        """Walks from a table, or all walks of the profile's generator computed once."""
        made = paths if paths is not None else walks.footpaths(self.snapshot.stops, self.profile.walks)
        return replace(self, paths=made.persist())

    def between(self, sources: str | Sequence[str], targets: str | Sequence[str]) -> Planner:
        return replace(self, sources=_ids(sources), targets=_ids(targets))

    def between_places(self, source: tuple[float, float], target: tuple[float, float], metres: float = 1000.0) -> Planner:
        """As between, by the stops nearest to two places (lon, lat)."""
        return self.between(self.closest(*source, metres), self.closest(*target, metres))

    def at(self, stops: str | Sequence[str]) -> Planner:
        return replace(self, sources=_ids(stops), targets=())

    def window(self, start: int | datetime, end: int | datetime) -> Planner:
        return replace(self, start=epoch(start), end=epoch(end))

    def closest(self, lon: float, lat: float, metres: float = 1000.0) -> str:
        found = geo.find_closest(self.snapshot.stops, lon, lat, metres).first()
        if found is None:
            raise filters.UnknownId(f"no stop within {metres:g} m of {lon}, {lat}")
        return found["stop_id"]

    def reset_filter(self) -> Planner:
        return replace(self, filtered=False)

    def check(self, targets: bool = True) -> None:
        """Raises InvalidRequest unless stops and window are set and fit."""
        if not self.sources or (targets and not self.targets):
            raise InvalidRequest("stops are missing")
        if set(self.sources) & set(self.targets):
            raise InvalidRequest("a stop is both start and end")
        if self.start is None or self.end is None or self.start >= self.end:
            raise InvalidRequest("the window is empty")
        if self.start <= 0 or self.end >= 253402300799:
            raise InvalidRequest("the window has no bound")
        filters.find_stops(self.snapshot.stops, [*self.sources, *self.targets])

    # --- answers ---------------------------------------------------------------------------------------------------

    def _connections(self) -> DataFrame:
        own = self.snapshot.connections
        keep = all_of(self.profile.connection_filter)
        return own if keep is None else own.where(keep)

    def _walks(self) -> DataFrame:
        return self.paths if self.paths is not None else walks.footpaths(self.snapshot.stops, self.profile.walks)

    def _origins(self, stops: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(0, s) for s in stops], "query_id int, stop string")

    def isochrone_from(self) -> DataFrame:
        """(stop, arrival) of all stops reached within the window."""
        self.check(targets=False)
        out = rounds.earliest_arrivals(self._connections(), self._origins(self.sources), self.start, self.end, self.profile.transfer, self._walks())
        return out.select("stop", "arrival")

    def isochrone_to(self) -> DataFrame:
        """(stop, departure) of all stops from which the stops are reached within the window."""
        self.check(targets=False)
        out = rounds.latest_departures(self._connections(), self._origins(self.sources), self.start, self.end, self.profile.transfer, self._walks())
        return out.select("stop", "departure")

    def requests(self) -> DataFrame:
        row = (0, list(self.sources), list(self.targets), self.start, self.end)
        return self.spark.createDataFrame([row], "query_id int, from_stops array<string>, to_stops array<string>, start_time bigint, end_time bigint")

    def earliest_arrival(self) -> DataFrame:
        self.check()
        return plan(self.requests(), self, "earliest")

    def latest_departure(self) -> DataFrame:
        self.check()
        return plan(self.requests(), self, "latest")

    def all_journeys(self) -> DataFrame:
        """All journeys none beats, in order of departure; no rows when there are none."""
        self.check()
        out = plan(self.requests(), self, "all")
        if self.profile.max_transfers is not None:
            out = out.where(filters.max_transfers(self.profile.max_transfers))
        return out.orderBy("departure", "journey_id")

    def profile_to(self) -> DataFrame:
        """(stop, dep, arr, vehicles): the journeys none beats from every stop to the stops chosen, without walks."""
        self.check(targets=False)
        return rounds.profiles(self._connections(), list(self.sources), self.start, self.end, self.profile.transfer)

    def direct(self) -> DataFrame:
        """(from_stop, to_stop, secs): walking only."""
        if not self.sources or not self.targets:
            raise InvalidRequest("stops are missing")
        own = self.snapshot.stops
        return walks.footpaths(own.where(F.col("stop_id").isin(list(self.sources))), self.profile.walks, own.where(F.col("stop_id").isin(list(self.targets))))

    def with_isochrone_filter(self, expand: Callable[[int, int], int] | None = None) -> Planner:
        """A planner whose searches for all journeys only take connections of use: those reached from the sources and from which the targets are reached.

        The scans that find them run beside the search itself. expand gives the end of the window from the start and the earliest arrival.
        """
        self.check()
        end = self.end
        if expand is not None:
            first = self.earliest_arrival().select("arrival").first()
            end = min(end, expand(self.start, first[0])) if first is not None else end
        return replace(self, filtered=True, end=end)

    def isochrones(self) -> tuple[DataFrame, DataFrame]:
        """What the filter knows, as tables: (stop, arrival) from the sources, (stop, departure) to the targets."""
        self.check()
        return replace(self, targets=()).isochrone_from(), replace(self, sources=self.targets, targets=()).isochrone_to()

    def connections_of_use(self) -> DataFrame:
        """The connections that the filter keeps, by joins with the isochrones."""
        earlier, later = self.isochrones()
        ends = [*self.sources, *self.targets]
        kept = filters.isochrone_filter_with_exceptions(self._connections(), earlier, ends)
        return filters.isochrone_filter_with_exceptions(kept, later, ends, backward=True)


def _ids(x: str | Sequence[str]) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


def plan(requests: DataFrame, planner: Planner, kind: str, most_bytes: int | None = None) -> DataFrame:
    """Journeys for a table of requests (query_id, from_stops, to_stops, start_time, end_time); kind: earliest, latest, all or frontier.

    frontier: (query_id, departure, arrival, vehicles) of all journeys, once however many are equally good; the others come with their legs.
    The connections of the requests' windows go to the tasks once if they are few enough, checked by counting their bytes; each task then answers its requests by
    scans. Beyond that (KERNEL_BYTES) requests that one scan serves are scanned together over the trips and walks of use to them, found by rounds; the answers are the same.
    """
    spark = requests.sparkSession
    first, last = requests.agg(F.min("start_time"), F.max("end_time")).first()
    schema = FRONTIER if kind == "frontier" else f"query_id int, journey_id int, legs array<{LEG}>"
    if first is None:
        return spark.createDataFrame([], FRONTIER if kind == "frontier" else JOURNEYS)
    window = stored(rounds.in_window(planner._connections(), first, last), "window")
    paths = stored(planner._walks().select("from_stop", "to_stop", F.col("secs").cast("bigint").alias("secs")), "walks")
    # One scan serves requests from or to the same stops. Where legs of all journeys are spelled out, they are spread over up to a few tasks.
    family = [F.col("from_stops" if kind == "earliest" else "to_stops"), F.col("start_time"), F.col("end_time"), *([F.pmod("query_id", F.lit(SPREAD))] if kind == "all" else [])]
    asked = requests.select("query_id", "from_stops", "to_stops", "start_time", "end_time", F.xxhash64(*family).alias("family"))
    answer = _answer(planner.profile, kind, planner.filtered, schema)
    if _bytes(window) + _bytes(paths) > (KERNEL_BYTES if most_bytes is None else most_bytes):
        found = _by_family(asked, window, paths, planner.profile, answer, schema)
    else:
        # Sorted and numbered once, so that a task only holds the columns.
        shared = spark.sparkContext.broadcast(kernel.Timetable.of(window.toArrow(), _tuples(paths.toArrow())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from answer(shared.value, batch.to_pylist()).to_batches()

        found = asked.repartition(spark.sparkContext.defaultParallelism, "family").mapInArrow(run, schema)
    if kind == "frontier":
        return found
    measured = journeys.measure(found)
    return measured.select("query_id", "journey_id", "departure", "arrival", F.col("vehicles").cast("int").alias("vehicles"), "travel_time", "walking_time", "legs")


def _bytes(rows: DataFrame) -> int:
    """What the rows take as values, before any of them comes to the driver."""
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    own = F.lit(8 * len(rows.columns))
    for c in texts:
        own = own + F.coalesce(F.octet_length(c), F.lit(0))
    return int(rows.agg(F.sum(own.cast("bigint"))).first()[0] or 0)


def _tuples(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns)))


def _answer(profile: Profile, kind: str, filtered: bool, schema: str) -> Callable[[kernel.Timetable, list[dict]], pa.Table]:
    """Rows (query_id, journey_id, legs), or of the frontier, of requests by scans of a timetable."""
    transfer, legacy, keep = profile.transfer, profile.legacy_transfer, profile.journey_filter
    most = None if profile.max_transfers is None else profile.max_transfers + 1
    names = ("kind", "conn_id", "trip_id", "from_stop", "to_stop", "dep", "arr")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def frontiers(table: kernel.Timetable, own: list[dict], ask: tuple) -> Iterator[tuple]:
        # Connections of use to any of the requests.
        allowed = kernel.of_use(table, sorted({s for r in own for s in r["from_stops"]}), *ask) if filtered else None
        found = kernel.frontier_scan(table, *ask, legacy, most, allowed, keep)
        for r in own:
            for e in kernel.pareto([e for s in r["from_stops"] for e in found.get(s, ())]):
                yield r["query_id"], *e

    def spelled(table: kernel.Timetable, own: list[dict], ask: tuple) -> Iterator[tuple]:
        if kind == "all":
            # A profile to the targets serves all requests for them; alone, a request takes only what is of use to it.
            shared = kernel.profile_scan(table, *ask, legacy, most, keep=keep) if len(own) > 1 and not filtered else None
        else:
            best = kernel.best_of_all(table, [(r["from_stops"], r["to_stops"]) for r in own], *ask[1:], kind == "latest")
        for n, r in enumerate(own):
            if kind != "all":
                found = [] if best[n] is None else [best[n]]
            elif shared is not None:
                found = kernel.journeys_from(table, shared, r["from_stops"])
            else:
                allowed = kernel.of_use(table, r["from_stops"], *ask) if filtered else None
                found = kernel.all_journeys(table, r["from_stops"], *ask, legacy_transfer=legacy, max_vehicles=most, allowed=allowed, keep=keep)
            for k, legs in enumerate(found):
                yield r["query_id"], k, [dict(zip(names, x)) for x in legs]

    def answer(table: kernel.Timetable, requests: list[dict]) -> pa.Table:
        alike: dict[tuple, list[dict]] = defaultdict(list)
        for r in requests:
            alike[tuple(r["from_stops" if kind == "earliest" else "to_stops"]), r["start_time"], r["end_time"]].append(r)
        out = []
        for (stops, start, end), own in alike.items():
            out += (frontiers if kind == "frontier" else spelled)(table, own, (list(stops), start, end, transfer))
        columns = list(zip(*out)) or [()] * len(arrow)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return answer


def _by_family(asked: DataFrame, window: DataFrame, paths: DataFrame, profile: Profile, answer: Callable, schema: str) -> DataFrame:
    """Each family of requests scanned over the trips of its window that they can board and that still lead to their targets, whole, and the walks between such stops.

    Rounds run for all families of one window at once; there should be few windows. A family's own trips meet in one task.
    """
    # Without the enforced transfer, scans of the profile change after a second.
    transfer = min(profile.transfer, 1) if profile.legacy_transfer else profile.transfer
    trips, walked = [], []
    for w in asked.select("start_time", "end_time").distinct().toLocalIterator():
        start, end = w["start_time"], w["end_time"]
        own = asked.where((F.col("start_time") == start) & (F.col("end_time") == end))
        live = window.where((F.col("dep_time") >= start) & (F.col("dep_time") < end) & (F.col("arr_time") <= end))
        ends = lambda c, own=own: own.select(F.col("family").alias("query_id"), F.explode(c).alias("stop")).distinct()
        reached = rounds.earliest_arrivals(window, ends("from_stops"), start, end, transfer, paths)
        leads = rounds.latest_departures(window, ends("to_stops"), start, end, transfer, paths)
        board = reached.join(live.where(can_get_on()), F.col("stop") == F.col("dep_stop")).where(F.col("dep_time") >= F.col("ready")).groupBy("query_id", "trip_id").agg(F.min("dep_time").alias("boarded"))
        leave = leads.join(live.where(can_get_off()), F.col("stop") == F.col("arr_stop")).where(F.col("arr_time") <= F.col("ready")).groupBy("query_id", "trip_id").agg(F.max("dep_time").alias("left"))
        trips.append(board.join(leave, ["query_id", "trip_id"]).where(F.col("boarded") <= F.col("left")).select("query_id", "trip_id"))
        on = reached.select("query_id", F.col("stop").alias("from_stop")).join(paths, "from_stop")
        walked.append(on.join(leads.select("query_id", F.col("stop").alias("to_stop")), ["query_id", "to_stop"]).select("query_id", "from_stop", "to_stop", "secs"))
    rides = reduce(DataFrame.unionByName, trips).distinct().join(window, "trip_id").select(F.col("query_id").alias("family"), *window.columns)
    foot = reduce(DataFrame.unionByName, walked).distinct().select(F.col("query_id").alias("family"), F.col("from_stop").alias("dep_stop"), F.col("to_stop").alias("arr_stop"), F.col("secs").cast("bigint").alias("dep_time"), F.lit(0).cast("bigint").alias("arr_time"), F.lit(0).cast("smallint").alias("mode"))
    pieces = rides.unionByName(foot, allowMissingColumns=True)

    def run(requests: pa.Table, own: pa.Table) -> pa.Table:
        ride = own["conn_id"].is_valid()
        table = kernel.Timetable.of(own.select(list(kernel.NAMES)).filter(ride), _tuples(own.filter(pc.invert(ride)).select(["dep_stop", "arr_stop", "dep_time"])))
        return answer(table, requests.to_pylist())

    return asked.groupBy("family").cogroup(pieces.groupBy("family")).applyInArrow(run, schema)
