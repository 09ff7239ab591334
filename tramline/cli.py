"""The command line: switches read, change, check and write snapshots, from left to right."""

from __future__ import annotations

import glob
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from .functions.parsers import parse_span, parse_time, timezone_report
from .model import Snapshot
from .operators import aggregates, filters, sets, validate
from .operators.filters import remove_delays
from .sources import gtfs, lc, osm, sinks, snapshots
from .storage import shared_dir


class UsageError(ValueError):
    """Arguments that no switch takes."""


@dataclass(frozen=True)
class Switch:
    """kind: source (adds a snapshot), modifier (changes all), sink (uses each). parameters: (name, default); a default of ... is required."""

    names: tuple[str, ...]
    kind: str
    parameters: tuple[tuple[str, object], ...]
    run: Callable
    help: str


def parse_arguments(switch: Switch, words: list[str]) -> dict[str, str]:
    """key=value, -flag value, or a bare value for the next parameter not yet given."""
    given: dict[str, str] = {}
    known = [p for p, _ in switch.parameters]
    k = 0
    while k < len(words):
        word = words[k]
        if word.startswith("-") and word.lstrip("-") in known:
            if k + 1 == len(words):
                raise UsageError(f"{word} needs a value")
            name, value, k = word.lstrip("-"), words[k + 1], k + 1
        elif "=" in word and word.split("=", 1)[0].lstrip("-") in known:
            name, value = word.lstrip("-").split("=", 1)
        elif word.startswith("-") and not word.lstrip("-").replace(".", "").isdigit():
            raise UsageError(f"{switch.names[0]} takes no {word}")
        else:
            left = [p for p in known if p not in given]
            if not left:
                raise UsageError(f"{switch.names[0]} takes no more than {len(known)} values")
            name, value = left[0], word
        if name in given:
            raise UsageError(f"{name} is given twice")
        given[name] = value
        k += 1
    for name, default in switch.parameters:
        if default is ... and name not in given:
            raise UsageError(f"{switch.names[0]} needs {name}")
    return {p: given.get(p, d) for p, d in switch.parameters}


def parse(argv: list[str]) -> list[tuple[Switch, dict[str, str]]]:
    """The switches of a command line with their parameters."""
    out: list[tuple[Switch, list[str]]] = []
    by_name = {n: s for s in SWITCHES for n in s.names}
    for word in argv:
        if word.startswith("--"):
            if word not in by_name:
                raise UsageError(f"no switch is named {word}")
            out.append((by_name[word], []))
        elif not out:
            raise UsageError(f"{word} stands before any switch")
        else:
            out[-1][1].append(word)
    return [(s, parse_arguments(s, words)) for s, words in out]


def check(parsed: list[tuple[Switch, dict]]) -> None:
    kinds = [s.kind for s, _ in parsed]
    if not {"source", "modifier"} & set(kinds) and "misc" not in kinds:
        raise UsageError("nothing is read")
    if "sink" not in kinds and "misc" not in kinds:
        raise UsageError("nothing is written")


@dataclass
class State:
    spark: SparkSession
    snapshots: list[Snapshot] = field(default_factory=list)
    out: Callable[[str], None] = print


def execute(state: State, parsed: list[tuple[Switch, dict]]) -> list[Snapshot]:
    for switch, given in parsed:
        if switch.kind == "modifier":
            state.snapshots = [switch.run(state, s, given) for s in state.snapshots]
        elif switch.kind == "sink":
            for s in state.snapshots:
                switch.run(state, s, given)
        else:
            switch.run(state, given)
    return state.snapshots


def _show(state: State, rows) -> None:
    """Every row, a partition at a time."""
    for r in rows.toLocalIterator():
        state.out("\t".join("" if v is None else str(v) for v in r))


def _times(given: dict) -> tuple[datetime, int]:
    start = parse_time(given["start"])
    return start, parse_span(given["duration"], start)


def _read_gtfs(state: State, given: dict) -> None:
    """One snapshot for each feed."""
    start, secs = _times(given)
    first = start.date()
    last = (start + timedelta(seconds=max(secs - 1, 0))).date()
    for path in _paths(given["path"]):
        state.snapshots.append(gtfs.load(gtfs.read_feed(state.spark, path), first, last))


def _paths(text: str) -> list[str]:
    """Paths separated by commas, each of which may be a pattern of local files."""
    return [p for part in text.split(",") for p in (sorted(glob.glob(part)) or [part])]


def _read_lc(state: State, given: dict) -> None:
    """From folders, or over HTTP through the shared folder."""
    start, secs = _times(given)
    at = int(start.timestamp())
    if given["connections"].startswith(("http://", "https://")):
        folder = f"{shared_dir(state.spark)}/pages-{uuid.uuid4().hex}"
        state.snapshots.append(lc.use_linked_connections(state.spark, given["connections"], given["locations"], start, start + timedelta(seconds=secs), folder))
        return
    state.snapshots.append(lc.read_linked_connections(state.spark, given["connections"], given["locations"], at, at + secs))


def _read_osm(state: State, given: dict) -> None:
    start, secs = _times(given)
    at = int(start.timestamp())
    state.snapshots.append(osm.load_route(state.spark, given["relation"], at, at + secs))


def _read_db(state: State, given: dict) -> None:
    state.snapshots += [snapshots.read(state.spark, p) for p in _paths(given["file"])]


def _select_time(state: State, snap: Snapshot, given: dict) -> Snapshot:
    start, secs = _times(given)
    at = int(start.timestamp())
    return filters.select_time(snap, at, at + secs, str(given["allow-empty"]) == "true")


def _box(state: State, snap: Snapshot, given: dict) -> Snapshot:
    return filters.select_bounding_box(snap, *(float(given[k]) for k in ("left", "bottom", "right", "top")), str(given["allow-empty"]) == "true")


def _validate(state: State, snap: Snapshot, given: dict) -> None:
    found = validate.validate(snap, str(given["relax"]) == "true")
    if given["type"] != "*":
        found = found.where(found["type"] == given["type"])
    _show(state, aggregates.validation_histogram(found).orderBy("type"))
    _show(state, validate.cutoff(found, int(given["cutoff"])).orderBy("type", "conn_id"))


def _merge(state: State, given: dict) -> None:
    state.snapshots = [sets.merge(state.snapshots)]


def _write_db(state: State, snap: Snapshot, given: dict) -> None:
    path = given["file"] or snapshots.default_name(snap.global_id or "db", datetime.now(timezone.utc))
    snapshots.write(snap, path)


def _vector_tiles(state: State, snap: Snapshot, given: dict) -> None:
    sinks.tile_features(snap, int(given["minzoom"]), int(given["maxzoom"])).write.partitionBy("zoom").parquet(given["directory"])
    state.out(sinks.tile_manifest(snap, snap.global_id, int(given["minzoom"]), int(given["maxzoom"])))


def _help(state: State, given: dict) -> None:
    for s in SWITCHES:
        if given["about"] in (None, *s.names):
            state.out(f"{', '.join(s.names)}: {s.help} Parameters: " + ", ".join(f"{p}{'' if d is ... else f' ({d})'}" for p, d in s.parameters))


def _shell(state: State, given: dict) -> None:
    """Reads command lines until one is empty, 'q' or the end; a mistake is reported and the shell goes on."""
    for line in given["input"] or sys.stdin:
        words = line.split()
        if not words or words[0] in ("q", "quit", "exit"):
            return
        try:
            execute(state, parse([("--" if not words[0].startswith("--") else "") + words[0], *words[1:]]))
        except (UsageError, ValueError, KeyError) as e:
            state.out(f"{type(e).__name__}: {e}")
        for s in state.snapshots:
            _show(state, aggregates.shell_state(s))


def _clear(state: State, given: dict) -> None:
    state.snapshots = []


def _collect_garbage(state: State, given: dict) -> None:
    import gc

    gc.collect()
    state.spark.catalog.clearCache()


_TIME = (("start", "today"), ("duration", "1day"))
_EMPTY = ("allow-empty", "false")
SWITCHES: list[Switch] = [
    Switch(("--read-gtfs", "--rgtfs"), "source", (("path", ...), *_TIME), _read_gtfs, "Reads unpacked feeds for the days of a window."),
    Switch(("--read-lc", "--read-linked-connections", "--rlc"), "source", (("connections", ...), ("locations", ...), *_TIME), _read_lc, "Reads pages and locations, downloaded or over HTTP."),
    Switch(("--read-osm", "--read-open-street-map-relation", "--rosm"), "source", (("relation", ...), *_TIME), _read_osm, "Reads a route relation and makes its runs."),
    Switch(("--read-transit-db", "--read", "--rdb"), "source", (("file", ...),), _read_db, "Reads written snapshots."),
    Switch(("--select-time", "--filter-time"), "modifier", (("start", ...), ("duration", ...), _EMPTY), _select_time, "Keeps departures of a window."),
    Switch(("--select-bounding-box", "--bounding-box", "--bbox"), "modifier", (("left", ...), ("right", ...), ("top", ...), ("bottom", ...), _EMPTY), _box, "Keeps connections within a box."),
    Switch(("--select-stop", "--filter-stop"), "modifier", (("id", ...), _EMPTY), lambda st, s, g: filters.select_stops(s, g["id"], str(g["allow-empty"]) == "true"), "Keeps connections that touch a stop."),
    Switch(("--select-trip", "--filter-trip"), "modifier", (("id", ...),), lambda st, s, g: filters.select_trip(s, g["id"]), "Keeps one trip."),
    Switch(("--undo-delays", "--remove-delays"), "modifier", (), lambda st, s, g: s.with_tables(connections=remove_delays(s.connections)), "Times as planned."),
    Switch(("--remove-unused", "--rm-unused"), "modifier", (), lambda st, s, g: filters.remove_unused(s), "Drops stops and trips that no connection uses."),
    Switch(("--validate",), "sink", (("type", "*"), ("cutoff", "10"), ("relax", "false")), _validate, "Reports faults of trips."),
    Switch(("--show-info", "--info"), "sink", (), lambda st, s, g: _show(st, sinks.show_info(s)), "Prints ids and attributes."),
    Switch(("--write-transit-db", "--write", "--wdb"), "sink", (("file", None),), _write_db, "Writes a snapshot."),
    Switch(("--write-stops",), "sink", (("file", ...),), lambda st, s, g: sinks.write_csv(sinks.stops_table(s), g["file"]), "Writes stops as CSV."),
    Switch(("--write-trips",), "sink", (("file", ...),), lambda st, s, g: sinks.write_csv(sinks.trips_table(s), g["file"]), "Writes trips as CSV."),
    Switch(("--write-connections",), "sink", (("file", ...), ("human", "false")), lambda st, s, g: sinks.write_csv(sinks.connections_table(s, str(g["human"]) == "true"), g["file"]), "Writes connections as CSV."),
    Switch(("--write-routes",), "sink", (), lambda st, s, g: _show(st, sinks.routes_table(s).orderBy("route")), "Prints routes."),
    Switch(("--write-vector-tiles", "--write-tiles"), "sink", (("directory", ...), ("minzoom", "3"), ("maxzoom", "14")), _vector_tiles, "Writes tile features."),
    Switch(("--help", "--?"), "misc", (("about", None),), _help, "Explains switches."),
    Switch(("--shell", "--interactive", "--i"), "misc", (("input", None),), _shell, "Reads switches line by line."),
    Switch(("--clear",), "misc", (), _clear, "Forgets all snapshots."),
    Switch(("--gc", "--garbage-collect"), "misc", (), _collect_garbage, "Frees memory."),
    Switch(("--merge",), "misc", (), _merge, "Makes one snapshot of all."),
    Switch(("--timezone",), "misc", (("zone", ...), ("time", "now")), lambda st, g: st.out(timezone_report(str(ZoneInfo(g["zone"])), parse_time(g["time"]))), "Shows a time in a zone."),
]


def main(argv: list[str] | None = None) -> int:
    parsed = parse(sys.argv[1:] if argv is None else argv)
    check(parsed)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    execute(State(spark), parsed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
