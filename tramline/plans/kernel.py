"""Connection scans in one task, for journeys with all their legs (Dibbelt et al., Connection Scan Algorithm).

The timetable of the window is held as columns in order of departure. The earliest-arrival scan keeps two labels a stop, for arrival and for
boarding; the latest-departure scan is the same on the mirrored timetable; the profile scan runs backward and keeps, for each stop and each
trip, the journeys none beats, with all equally good ways on; the frontier scan is the profile scan without the ways.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Connections that a scan holds as Python values at a time.
CHUNK = 1 << 16
NAMES = ("conn_id", "dep_stop", "arr_stop", "dep_time", "arr_time", "mode", "trip_id")

Leg = tuple[str, str | None, str | None, str, str, int, int]


@dataclass
class Rows(Sequence):
    """Connections as columns, read back as tuples (conn_id, dep_stop, arr_stop, dep_time, arr_time, mode, trip_id); stops and trips are numbered."""

    conns: pa.Array
    trips: pa.Array
    stops: list[str]
    a: np.ndarray
    b: np.ndarray
    dep: np.ndarray
    arr: np.ndarray
    mode: np.ndarray
    trip: np.ndarray
    #: Where the id of a connection stands in conns; None: at its own place.
    at: np.ndarray | None = None

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        """The connections of a table, in its order."""
        ends = pa.chunked_array([*table["dep_stop"].chunks, *table["arr_stop"].chunks], table["dep_stop"].type).combine_chunks().dictionary_encode(null_encoding="encode")
        trips = table["trip_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        stop, n = ends.indices.to_numpy(), table.num_rows
        number = lambda c, kind: table[c].to_numpy().astype(kind, copy=False)
        return cls(table["conn_id"].combine_chunks(), trips.dictionary, ends.dictionary.to_pylist(), stop[:n], stop[n:], number("dep_time", np.int64), number("arr_time", np.int64), number("mode", np.int8), trips.indices.to_numpy())

    def taken(self, order: np.ndarray, **others: np.ndarray) -> Rows:
        """The connections in another order; others: columns that take the place of their own."""
        columns = {c: getattr(self, c)[order] for c in ("a", "b", "dep", "arr", "mode", "trip") if c not in others}
        return replace(self, **columns, **others, at=order if self.at is None else self.at[order])

    def outermost(self, last: bool = False) -> bytes:
        """For each connection whether it is the first (or last) of its trip."""
        own = self.trip[::-1] if last else self.trip
        marks = np.zeros(len(own), bool)
        marks[np.unique(own, return_index=True)[1]] = True
        return (marks[::-1] if last else marks).tobytes()

    def __len__(self) -> int:
        return len(self.dep)

    def __getitem__(self, i: int) -> tuple:
        if i >= len(self):
            raise IndexError(i)
        conn = self.conns[int(i if self.at is None else self.at[i])].as_py()
        return conn, self.stops[self.a[i]], self.stops[self.b[i]], int(self.dep[i]), int(self.arr[i]), int(self.mode[i]), self.trips[int(self.trip[i])].as_py()

    def scan(self, first: int, last: int, back: bool = False) -> Iterator[tuple]:
        """(place, dep_stop, arr_stop, dep_time, arr_time, mode, number of the trip) from first to before last, or the other way; a chunk at a time."""
        name = self.stops.__getitem__
        starts = range(first, last, CHUNK)
        for at in reversed(starts) if back else starts:
            end = min(at + CHUNK, last)
            own = (np.arange(at, end), self.a[at:end], self.b[at:end], self.dep[at:end], self.arr[at:end], self.mode[at:end], self.trip[at:end])
            i, a, b, *rest = ((c[::-1] if back else c).tolist() for c in own)
            yield from zip(i, map(name, a), map(name, b), *rest)

    def hops(self, first: int, last: int) -> list[tuple]:
        """The connections of a trip from one to another of it."""
        return [self[k] for k in (first + np.flatnonzero(self.trip[first : last + 1] == self.trip[first])).tolist()]


class Timetable:
    """Connections (conn_id, dep_stop, arr_stop, dep_time, arr_time, mode, trip_id) in order of departure, and walks {stop: [(stop, secs)]}."""

    def __init__(self, rows: Sequence[tuple], walks: dict[str, list[tuple[str, int]]] | None = None):
        self.rows = rows if isinstance(rows, Rows) else Rows.of(_table(rows))
        self.walks = walks or {}
        self._mirrored: Timetable | None = None

    @classmethod
    def of(cls, rows: Sequence[tuple] | pa.Table, walks: list[tuple[str, str, int]] = ()) -> Timetable:
        by_stop: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for a, b, secs in walks:
            by_stop[a].append((b, secs))
        table = rows if isinstance(rows, pa.Table) else _table(rows)
        live = pc.equal(pc.bit_wise_and(table["mode"], pa.scalar(4, table["mode"].type)), 0)
        if not pc.all(live, min_count=0).as_py():
            table = table.filter(live)
        order = pc.sort_indices(table, sort_keys=[("dep_time", "ascending"), ("arr_time", "ascending"), ("conn_id", "ascending")]).to_numpy()
        # Ids stay where they are.
        return cls(Rows.of(table).taken(order), dict(by_stop))

    def first_from(self, time: int) -> int:
        """Where connections that leave at a time or later begin."""
        return int(np.searchsorted(self.rows.dep, time))

    def mirrored(self) -> Timetable:
        """Time runs backward: who gets on gets off. It is made once."""
        if self._mirrored is None:
            back: dict[str, list[tuple[str, int]]] = defaultdict(list)
            for a, own in self.walks.items():
                for b, secs in own:
                    back[b].append((a, secs))
            rows = self.rows
            # Stable: connections of the same times stay in order of their ids.
            at = np.lexsort((-rows.dep, -rows.arr))
            swap = np.array([0, 2, 1, 3], np.int8)
            self._mirrored = Timetable(rows.taken(at, a=rows.b[at], b=rows.a[at], dep=-rows.arr[at], arr=-rows.dep[at], mode=swap[rows.mode[at] % 4]), dict(back))
        return self._mirrored


def _table(rows: Sequence[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int16(), pa.string())
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)


@dataclass
class Node:
    """How a stop was reached: a ride from one connection to another, a walk, or (before None) the start."""

    stop: str
    time: int
    before: Node | None = None
    ride: tuple[int, int] | None = None


def scan(table: Timetable, sources: list[str], targets: list[str], start: int, end: int, transfer: int, expand_to: int | None = None, aboard: np.ndarray | None = None, every: bool = False) -> tuple[Node | None, dict[str, Node]]:
    """The best arrival at a target, and the best node of every stop. Without targets the whole window is scanned.

    expand_to: once a target is reached, go on to this departure time so that the labels can serve as a filter. aboard takes the
    departure from which each trip (by number) can be ridden; trips that ended are let go. every: go on until all targets are reached at their best.
    """
    rows = table.rows
    best: dict[str, Node] = {}
    ready: dict[str, tuple[int, Node]] = {}
    boarded: dict[int, tuple[int, Node]] = {}
    finishes = rows.outermost(last=True) if aboard is not None else None
    wanted, origins = set(targets), set(sources)

    def walk(node: Node) -> None:
        for to, secs in table.walks.get(node.stop, ()):
            at = node.time + secs
            if at <= end:
                if to not in best or at < best[to].time:
                    best[to] = Node(to, at, node)
                if to not in ready or at < ready[to][0]:
                    ready[to] = (at, Node(to, at, node))

    for s in sources:
        node = Node(s, start)
        best[s] = node
        ready[s] = (start, node)
    for s in sources:
        walk(best[s])
    rides: dict[str, int] = {}
    b_changed = True
    reached: int | None = None
    for i, a, b, dep, arr, mode, trip in rows.scan(table.first_from(start), table.first_from(end)):
        if b_changed:
            known = [best[t].time for t in wanted if t in best]
            reached = (max(known) if len(known) == len(wanted) else None) if every and wanted else min(known, default=None)
            b_changed = False
        bound = end if reached is None else min(end, max(reached, expand_to if expand_to is not None else reached))
        if dep > bound:
            break
        own = boarded.pop(trip, None) if finishes is not None and finishes[i] else boarded.get(trip)
        if own is None:
            if mode % 4 in (0, 1) and a in ready and ready[a][0] <= dep:
                own = (i, ready[a][1])
                if finishes is None or not finishes[i]:
                    boarded[trip] = own
                if aboard is not None:
                    aboard[trip] = dep
            else:
                continue
        elif mode % 4 in (0, 1) and a in origins and own[1].before is not None:
            # Boarding right here saves what came before.
            own = (i, Node(a, start))
            if finishes is None or not finishes[i]:
                boarded[trip] = own
        if mode % 4 in (0, 2):
            if b not in rides or arr < rides[b]:
                rides[b] = arr
                b_changed = True
                node = Node(b, arr, own[1], (own[0], i))
                if b not in best or arr < best[b].time:
                    best[b] = node
                if b not in ready or arr + transfer < ready[b][0]:
                    ready[b] = (arr + transfer, node)
                walk(node)
    found = [best[t] for t in targets if t in best and best[t].time <= end]
    return min(found, key=lambda n: n.time, default=None), best


def legs(table: Timetable, node: Node) -> list[Leg]:
    """The legs to a node, a ride leg for each connection; the walk before the first ride starts as late as it may."""
    steps = []
    at: Node | None = node
    while at is not None and at.before is not None:
        steps.append(at)
        at = at.before
    out: list[Leg] = []
    for step in reversed(steps):
        if step.ride is None:
            out.append(("walk", None, None, step.before.stop, step.stop, step.before.time, step.time))
            continue
        first, last = step.ride
        hops = table.rows.hops(first, last)
        trip = hops[0][6]
        if out and out[-1][0] == "ride" and out[-1][2] != trip:
            out.append(("transfer", None, None, out[-1][4], hops[0][1], out[-1][6], hops[0][3]))
        out += [("ride", c, t, a, b, dep, arr) for c, a, b, dep, arr, _, t in hops]
    if len(out) > 1 and out[0][0] == "walk" and out[1][0] == "ride":
        late = out[1][5] - out[0][6]
        out[0] = (*out[0][:5], out[0][5] + late, out[0][6] + late)
    return out


def earliest_arrival(table: Timetable, sources: list[str], targets: list[str], start: int, end: int, transfer: int = 180) -> list[Leg] | None:
    node, _ = scan(table, sources, targets, start, end, transfer)
    return None if node is None else legs(table, node)


def latest_departure(table: Timetable, sources: list[str], targets: list[str], start: int, end: int, transfer: int = 180) -> list[Leg] | None:
    """The journey that leaves last and still arrives by the end."""
    back = table.mirrored()
    node, _ = scan(back, targets, sources, -end, -start + 1, transfer)
    return None if node is None or -node.time < start else turned(legs(back, node))


def turned(own: list[Leg]) -> list[Leg]:
    """The legs of a journey through the mirrored timetable, in order of travel."""
    return [(k, c, t, b, a, -arr, -dep) for k, c, t, a, b, dep, arr in reversed(own)]


def best_of_all(table: Timetable, requests: list[tuple[list[str], list[str]]], start: int, end: int, transfer: int, latest: bool) -> list[list[Leg] | None]:
    """For requests (from stops, to stops) that all start at the same stops, or with latest all end there: the journey of each, by one scan."""
    if latest:
        table, requests, (start, end) = table.mirrored(), [(t, f) for f, t in requests], (-end, -start + 1)
    _, best = scan(table, requests[0][0], sorted({t for _, own in requests for t in own}), start, end, transfer, every=True)
    out: list[list[Leg] | None] = []
    for _, own in requests:
        found = [best[t] for t in own if t in best and best[t].time <= end - latest]
        node = min(found, key=lambda n: n.time, default=None)
        out.append(None if node is None else turned(legs(table, node)) if latest else legs(table, node))
    return out


@dataclass(eq=False)
class Way:
    """A way on from a seat in a trip: arrival, vehicles, and where to leave it: (connection, next entry or None, walk at the end or None)."""

    arr: int
    vehicles: int
    exits: list[tuple[int, object, tuple | None]]


@dataclass(eq=False)
class Entry:
    """A journey from a stop: departure, arrival, vehicles; the ways (connection boarded, way on), and the walk before it or None."""

    dep: int
    arr: int
    vehicles: int
    ways: list[tuple[int, Way]]
    walk: tuple[str, str, int] | None = None


def _pareto_ways(ways: list[Way]) -> list[Way]:
    merged: dict[tuple[int, int], Way] = {}
    for w in ways:
        own = merged.get((w.arr, w.vehicles))
        if own is None:
            merged[w.arr, w.vehicles] = Way(w.arr, w.vehicles, list(w.exits))
        else:
            own.exits += [x for x in w.exits if x not in own.exits]
    return [w for w in merged.values() if not any(o is not w and o.arr <= w.arr and o.vehicles <= w.vehicles for o in merged.values())]


def _add(profile: list[Entry], new: Entry) -> bool:
    for e in profile:
        if (e.dep, e.arr, e.vehicles) == (new.dep, new.arr, new.vehicles):
            e.ways += [w for w in new.ways if w not in e.ways] if e.walk == new.walk else []
            return False
        if e.dep >= new.dep and e.arr <= new.arr and e.vehicles <= new.vehicles:
            return False
    profile[:] = [e for e in profile if not (new.dep >= e.dep and new.arr <= e.arr and new.vehicles <= e.vehicles)]
    profile.append(new)
    return True


def of_use(table: Timetable, sources: list[str], targets: list[str], start: int, end: int, transfer: int = 180) -> np.ndarray:
    """For each connection whether it can be part of a journey: its departure stop or trip is reached by then, and the targets still are from its arrival stop or by its trip.

    Connections that touch a source or target, and those of a trip in use already, pass anyway. The scans go over the whole window.
    """
    rows = table.rows
    none = np.iinfo(np.int64).max
    on_at, off_at = (np.full(len(rows.trips), none) for _ in range(2))
    _, reached = scan(table, sources, [], start, end, transfer, aboard=on_at)
    _, back = scan(table.mirrored(), targets, [], -end, -start + 1, transfer, aboard=off_at)
    reached_at, left_at = (np.array([x[k].time if k in x else none for k in rows.stops], np.int64) for x in (reached, back))
    ends = np.isin(np.array(rows.stops, object), [*sources, *targets]) if rows.stops else np.zeros(0, bool)
    ahead = (reached_at[rows.a] <= rows.dep) | (on_at[rows.trip] <= rows.dep)
    behind = (left_at[rows.b] <= -rows.arr) | (off_at[rows.trip] <= -rows.arr)
    return ends[rows.a] | ends[rows.b] | (ahead & behind)


def no_use(found: list[Entry], e: Entry, now: int) -> bool:
    """Whether even a vehicle that left the start now and stood at once where e begins would be beaten by a journey found from the start that leaves later."""
    return any(f.dep > now and f.arr <= e.arr and f.vehicles <= e.vehicles for f in found)


def profile_scan(table: Timetable, targets: list[str], start: int, end: int, transfer: int = 180, legacy_transfer: bool = False, max_vehicles: int | None = None, allowed: np.ndarray | None = None, sources: list[str] | None = None, keep: Callable[[int, int, int], bool] | None = None) -> dict[str, list[Entry]]:
    """For every stop the journeys to the targets none beats.

    allowed: for each connection whether it may be taken; one whose trip is in use already may. keep(departure, arrival, vehicles): whether a
    partial journey may go on. With a single source, partial journeys that cannot become of use to it any more are not gone on with.
    """
    origin = sources[0] if sources is not None and len(sources) == 1 else None
    goals = set(targets)
    trips: dict[int, list[Way]] = {}
    codes = table.rows.trip
    profiles: dict[str, list[Entry]] = defaultdict(list)
    on_foot: dict[str, list[Entry]] = defaultdict(list)
    back: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for a, own in table.walks.items():
        for b, secs in own:
            back[b].append((a, secs))
    for i, a, b, dep, arr, mode, trip in table.rows.scan(table.first_from(start), table.first_from(end), back=True):
        if arr > end:
            continue
        # Walks are not timed by departures: a journey found that starts with one is no bound.
        ahead = profiles.get(origin, ()) if origin is not None else ()
        if allowed is not None and trip not in trips and not allowed[i]:
            continue
        ways = list(trips.get(trip, ()))
        if mode % 4 in (0, 2):
            if b in goals:
                ways.append(Way(arr, 1, [(i, None, None)]))
            else:
                last = min(((secs, to) for to, secs in table.walks.get(b, ()) if to in goals and arr + secs <= end), default=None)
                if last:
                    ways.append(Way(arr + last[0], 1, [(i, None, (b, last[1], last[0]))]))
                gap = 1 if legacy_transfer else transfer
                for e in profiles.get(b, ()):
                    if e.dep >= arr + gap and all(codes[j] != trip for j, _ in e.ways) and not no_use(ahead, e, dep):
                        ways.append(Way(e.arr, e.vehicles + 1, [(i, e, None)]))
                for e in on_foot.get(b, ()):
                    if e.dep >= arr and not no_use(ahead, e, dep):
                        ways.append(Way(e.arr, e.vehicles + 1, [(i, e, None)]))
        ways = [w for w in _pareto_ways(ways) if (max_vehicles is None or w.vehicles <= max_vehicles) and (keep is None or keep(dep, w.arr, w.vehicles))]
        if not ways:
            continue
        trips[trip] = ways
        if mode % 4 in (0, 1) and a not in goals:
            for w in ways:
                if _add(profiles[a], Entry(dep, w.arr, w.vehicles, [(i, w)])):
                    for near, secs in back.get(a, ()):
                        if dep - secs >= start and near not in goals:
                            _add(on_foot[near], Entry(dep - secs, w.arr, w.vehicles, [(i, w)], (near, a, secs)))
    out: dict[str, list[Entry]] = {}
    for stop in {*profiles, *on_foot}:
        own: list[Entry] = []
        for e in profiles.get(stop, []) + on_foot.get(stop, []):
            _add(own, e)
        out[stop] = sorted(own, key=lambda e: (e.dep, e.arr, e.vehicles))
    return out


#: The journeys of a stop with one number of vehicles: departures with their sign turned, rising, and arrivals, which fall.
Steps = tuple[list[int], list[int]]


def _put(own: list[Steps], dep: int, arr: int, vehicles: int) -> bool:
    """Adds a journey to those of a stop (one pair of lists for each number of vehicles), unless one of them is as good; by bisection."""
    for deps, arrs in own[:vehicles]:
        n = bisect_right(deps, -dep)
        if n and arrs[n - 1] <= arr:
            return False
    own += [([], []) for _ in range(vehicles - len(own))]
    deps, arrs = own[vehicles - 1]
    first = last = bisect_left(deps, -dep)
    while last < len(arrs) and arrs[last] >= arr:
        last += 1
    deps[first:last], arrs[first:last] = [-dep], [arr]
    return True


def frontier_scan(table: Timetable, targets: list[str], start: int, end: int, transfer: int = 180, legacy_transfer: bool = False, max_vehicles: int | None = None, allowed: np.ndarray | None = None, keep: Callable[[int, int, int], bool] | None = None) -> dict[str, list[tuple[int, int, int]]]:
    """For every stop the (departure, arrival, vehicles) of the journeys to the targets that none beats: a profile scan that knows no ways.

    What can still be caught at a stop is found by bisection, and equally good ways count once, so the time goes with the connections.
    """
    goals = set(targets)
    # Of trips under way, so that those that began are let go.
    trips: dict[int, list[tuple[int, int]]] = {}
    begins = table.rows.outermost()
    profiles: dict[str, list[Steps]] = defaultdict(list)
    on_foot: dict[str, list[Steps]] = defaultdict(list)
    back: dict[str, list[tuple[str, int]]] = defaultdict(list)
    to_goal: dict[str, int] = {}
    for a, own in table.walks.items():
        for b, secs in own:
            back[b].append((a, secs))
            if b in goals:
                to_goal[a] = min(secs, to_goal.get(a, secs))
    gap = 1 if legacy_transfer else transfer
    for i, a, b, dep, arr, mode, trip in table.rows.scan(table.first_from(start), table.first_from(end), back=True):
        if arr > end:
            continue
        ways = trips.pop(trip, None) if begins[i] else trips.get(trip)
        if allowed is not None and ways is None and not allowed[i]:
            continue
        if mode % 4 in (0, 2):
            # The least arrival for each number of vehicles.
            least = dict(ways or ())
            if b in goals:
                least[1] = min(arr, least.get(1, arr))
            else:
                if b in to_goal and arr + to_goal[b] <= end:
                    least[1] = min(arr + to_goal[b], least.get(1, end))
                for known, since in ((profiles, arr + gap), (on_foot, arr)):
                    for v, (deps, arrs) in enumerate(known.get(b, ()), 2):
                        n = bisect_right(deps, -since)
                        if n and (v not in least or arrs[n - 1] < least[v]):
                            least[v] = arrs[n - 1]
            ways = []
            for v in sorted(least):
                if not ways or least[v] < ways[-1][1]:
                    ways.append((v, least[v]))
        ways = [(v, t) for v, t in ways or () if (max_vehicles is None or v <= max_vehicles) and (keep is None or keep(dep, t, v))]
        if not ways:
            continue
        if not begins[i]:
            trips[trip] = ways
        if mode % 4 in (0, 1) and a not in goals:
            for v, t in ways:
                if _put(profiles[a], dep, t, v):
                    for near, secs in back.get(a, ()):
                        if dep - secs >= start and near not in goals:
                            _put(on_foot[near], dep - secs, t, v)
    return {stop: pareto(_spelled(profiles.get(stop, ())) + _spelled(on_foot.get(stop, ()))) for stop in {*profiles, *on_foot}}


def _spelled(own: Sequence[Steps]) -> list[tuple[int, int, int]]:
    return [(-d, t, v) for v, (deps, arrs) in enumerate(own, 1) for d, t in zip(deps, arrs)]


def pareto(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of (departure, arrival, vehicles) that no other is as good as, by departure; equal ones once."""
    out: list[tuple[int, int, int]] = []
    least: list[Steps] = []
    for dep, arr, v in sorted(set(found), key=lambda x: (-x[0], x[1], x[2])):
        if _put(least, dep, arr, v):
            out.append((dep, arr, v))
    return sorted(out)


def journeys_of(table: Timetable, entry: Entry) -> Iterator[list[Leg]]:
    """All equally good journeys of an entry, one after another; a walk that starts it comes first."""

    def paths(e: Entry) -> Iterator[list[Leg]]:
        before: list[Leg] = []
        if e.walk:
            a, b, secs = e.walk
            before = [("walk", None, None, a, b, e.dep, e.dep + secs)]
        for first, way in e.ways:
            for last, then, foot in way.exits:
                ride: list[Leg] = [("ride", c, t, a, b, dep, arr) for c, a, b, dep, arr, _, t in table.rows.hops(first, last)]
                if foot:
                    ride.append(("walk", None, None, foot[0], foot[1], ride[-1][6], ride[-1][6] + foot[2]))
                if then is None:
                    yield before + ride
                    continue
                for rest in paths(then):
                    link: list[Leg] = [] if rest[0][0] == "walk" else [("transfer", None, None, ride[-1][4], rest[0][3], ride[-1][6], rest[0][5])]
                    yield before + ride + link + rest

    yield from paths(entry)


def all_journeys(table: Timetable, sources: list[str], targets: list[str], start: int, end: int, transfer: int = 180, **options) -> list[list[Leg]]:
    """The journeys from any source to any target none beats, with alternatives, by departure; empty when there are none."""
    found = profile_scan(table, targets, start, end, transfer, sources=sources, **options)
    return journeys_from(table, found, sources)


def journeys_from(table: Timetable, found: dict[str, list[Entry]], sources: list[str]) -> list[list[Leg]]:
    """The journeys of a profile scan from any of the sources, with alternatives, by departure."""
    own: list[Entry] = []
    for s in sources:
        for e in found.get(s, []):
            _add(own, e)
    return [p for e in sorted(own, key=lambda e: (e.dep, e.arr, e.vehicles)) for p in journeys_of(table, e)]
