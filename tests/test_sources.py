"""Feeds, pages, relations, snapshots, refresh and the command line."""
import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tramline import cli, derive
from tramline.functions import geo, parsers
from tramline.model import STOPS
from tramline.operators import sets, validate
from tramline.sources import gtfs, lc, osm, sinks, snapshots
from tramline.streaming import refresh

UTC = timezone.utc


def feed(folder, **more):
    week = "monday,tuesday,wednesday,thursday,friday,saturday,sunday"
    files = {
        "agency": "agency_id,agency_name,agency_url,agency_timezone\n1,One,https://one.example,Europe/Brussels\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon\n1,First,51.0,3.0\n2,Second,51.1,3.1\n3,Unused,51.2,3.2\n",
        "routes": "route_id,agency_id,route_short_name,route_type\nr,1,R,2\n",
        "trips": "route_id,service_id,trip_id,trip_headsign\nr,s,t,Second\nr,none,u,Nowhere\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\nt,06:46:00,06:46:00,1,9,0,0\nt,06:52:00,06:52:00,2,10,0,0\n",
        "calendar": f"service_id,{week},start_date,end_date\ns,1,1,1,1,1,1,1,20190101,20201231\n",
    } | more
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text)
    return f"file://{folder}"


def test_gtfs(spark, tmp_path):
    path = feed(tmp_path / "feed")
    snap = gtfs.load(gtfs.read_feed(spark, path), date(2020, 1, 1), date(2020, 1, 1))
    assert sorted(r["stop_id"] for r in snap.stops.collect()) == ["https://one.example/stop/1", "https://one.example/stop/2"]
    (c,) = snap.connections.collect()
    assert c["travel_time"] == 360 and c["mode"] == 0 and c["conn_id"] == "https://one.example/connection/t/20200101/9"
    assert c["dep_time"] == int(datetime(2020, 1, 1, 5, 46, tzinfo=UTC).timestamp())
    (t,) = snap.trips.collect()
    assert t["trip_id"] == "https://one.example/trip/t/20200101" and t["attributes"]["headsign"] == "Second" and t["operator_id"] == "https://one.example/"
    every = gtfs.Settings(add_unused_stops=True, add_unused_trips=True)
    assert gtfs.load(gtfs.read_feed(spark, path), date(2020, 1, 1), date(2020, 1, 2), every).stops.count() == 3
    assert gtfs.load(gtfs.read_feed(spark, path), date(2022, 1, 1), date(2022, 1, 2)).connections.count() == 0
    wide = gtfs.Settings(use_calendar_range=False)
    assert gtfs.load(gtfs.read_feed(spark, path), date(2022, 1, 1), date(2022, 1, 2), wide).connections.count() == 2
    with pytest.raises(ValueError, match="dates"):
        gtfs.load(gtfs.read_feed(spark, path), datetime(2020, 1, 1), date(2020, 1, 2))
    legacy = gtfs.load(gtfs.read_feed(spark, path), date(2020, 1, 1), date(2020, 1, 1), gtfs.Settings(legacy_gtfs_mode=True))
    assert legacy.connections.first()["mode"] == 3


@pytest.mark.parametrize(("week", "changes", "day", "runs"), [
    ([], [], date(2020, 1, 6), False), ([], [("s", "20200106", 1)], date(2020, 1, 6), True), ([(1, 1, 1, 1, 1, 0, 0)], [("s", "20200106", 2)], date(2020, 1, 6), False),
    ([(1, 1, 1, 1, 1, 0, 0)], [], date(2020, 1, 10), True), ([(1, 1, 1, 1, 1, 0, 0)], [], date(2020, 1, 11), False), ([(1, 1, 1, 1, 1, 0, 0)], [("s", "20200111", 1)], date(2020, 1, 11), True),
])
def test_date_patterns(spark, week, changes, day, runs):
    calendar = spark.createDataFrame([("s", *w, "20200101", "20201231") for w in week], gtfs.EMPTY["calendar"])
    dates = spark.createDataFrame(changes, gtfs.EMPTY["calendar_dates"])
    assert (gtfs.active_days(calendar, dates, day, day).count() == 1) == runs


def page(minute, connections, follow=None):
    return json.dumps({"@id": f"http://x/c?departureTime=2020-01-06T10:{minute:02}:00.000Z", "hydra:next": follow, "@graph": connections})


def connection(i, dep, arr, a="A", b="B", kind="Connection", **more):
    return {"@id": f"c{i}", "@type": kind, "departureStop": a, "arrivalStop": b, "departureTime": f"2020-01-06T10:{dep:02}:00.000Z", "arrivalTime": f"2020-01-06T10:{arr:02}:00.000Z", "gtfs:trip": "t1", "gtfs:route": "r1", "headsign": "B"} | more


def test_linked_connections(spark, tmp_path):
    pages, places = tmp_path / "pages", tmp_path / "locations.json"
    base = "http://x/c"
    web = {
        f"{base}?departureTime=2020-01-06T10:00:00.000Z": page(0, [connection(1, 0, 9, departureDelay=60, arrivalDelay="120"), connection(2, 5, 4), connection(3, 6, 8, a="A", b="A"), connection(4, 7, 9, b="Z")], f"{base}?departureTime=2020-01-06T10:10:00.000Z"),
        f"{base}?departureTime=2020-01-06T10:10:00.000Z": page(10, [connection(5, 11, 15, kind="CancelledConnection"), connection(6, 12, 15, **{"gtfs:pickupType": "gtfs:NotAvailable"}), connection(5, 11, 15)], f"{base}?departureTime=2020-01-06T10:20:00.000Z"),
    }
    tries = []

    def fetch(uri, timeout):
        tries.append(uri)
        if len(tries) == 1:
            raise OSError("again")
        return web[uri].encode()

    loader = lc.Downloader(fetch=fetch)
    start, end = datetime(2020, 1, 6, 10, 0, 30, tzinfo=UTC), datetime(2020, 1, 6, 10, 20, tzinfo=UTC)
    assert lc.download_pages(spark, base, start, end, str(pages), loader) == (2, 0)
    assert lc.download_pages(spark, base, start, end, str(pages), loader) == (0, 2)
    places.write_text(json.dumps({"@graph": [{"@id": s, "name": f"Stop {s}", "latitude": "51.0", "longitude": "3.0", "alternative": [{"@language": "nl", "@value": f"Halte {s}"}]} for s in "AB"]}))
    at = int(start.timestamp()) - 30
    snap = lc.read_linked_connections(spark, f"file://{pages}", f"file://{places}", at, at + 3600)
    got = {r["conn_id"]: (r["mode"], r["travel_time"], r["attributes"]["departureDelay"]) for r in snap.connections.collect()}
    assert set(got) == {"c1", "c5", "c6"} and got["c1"] == (0, 540, "60") and got["c6"][0] == 2
    assert snap.stops.where("stop_id = 'A'").first()["attributes"]["name:nl"] == "Halte A"
    assert snap.trips.first()["attributes"] == {"headsign": "B", "trip": "t1", "route": "r1"}
    parsed = lc.parse_connections(lc.read_pages(spark, f"file://{pages}"))
    assert [tuple(r) for r in lc.rejects(parsed).collect()] == [("c2", "arrives before it leaves")]
    strange = tmp_path / "strange"
    strange.mkdir()
    (strange / "p.json").write_text(page(0, [connection(1, 0, 9, kind="Bus")]))
    with pytest.raises(lc.UnknownKind):
        lc.read_linked_connections(spark, f"file://{strange}", f"file://{places}", at, at + 3600)
    times = spark.createDataFrame([(f"{base}?departureTime=2020-01-06T10:10:00.000Z",), ("none",)], "u string").select(lc.page_time(F.col("u")).alias("t")).collect()
    assert times[0]["t"] == datetime(2020, 1, 6, 10, 10) and times[1]["t"] is None


def test_route_relation(spark, tmp_path):
    node = lambda i, lat, tags="": f'<node id="{i}" lat="{lat}" lon="3.0">{tags}</node>'
    member = lambda i, role: f'<member type="node" ref="{i}" role="{role}"/>'
    xml = f"""<osm>{node(1, 51.0, '<tag k="name" v="One"/>')}{node(2, 51.01)}{node(3, 51.02)}{node(4, 51.0001)}{node(5, 51.03)}
<relation id="9">{member(1, 'stop')}{member(2, 'stop')}{member(3, 'stop')}{member(4, 'platform')}{member(5, 'platform')}<tag k="type" v="route"/><tag k="name" v="Line"/><tag k="duration" v="0:20"/><tag k="interval" v="10"/></relation></osm>"""
    (tmp_path / "route.xml").write_text(xml)
    snap = osm.load_route(spark, f"file://{tmp_path}/route.xml", 1000, 2200)
    assert snap.stops.count() == 4  # the platform beside a stop is not one of its own
    rows = snap.connections.orderBy("dep_time", "conn_id").collect()
    assert len(rows) == 9 and {r["travel_time"] for r in rows} == {300}
    assert [r["mode"] for r in sorted(rows, key=lambda r: r["dep_time"]) if r["conn_id"].split("/")[-2] == "1000"] == [1, 0, 2]
    (tmp_path / "bad.xml").write_text(xml.replace('<tag k="duration" v="0:20"/>', ""))
    with pytest.raises(osm.BadRelation):
        osm.load_route(spark, f"file://{tmp_path}/bad.xml", 1000, 2200)
    urls = spark.createDataFrame([("https://www.openstreetmap.org/#map=19/51.21575/3.21999",), ("http://elsewhere",)], "url string")
    (stop,) = osm.floating_stops(urls).collect()
    assert (stop["lon"], stop["lat"]) == (3.21999, 51.21575)


def test_snapshots_and_writers(spark, tmp_path):
    snap = derive.snapshot(spark, "/root/testdata/sf0.001")
    snapshots.write(snap, f"file://{tmp_path}/db")
    back = snapshots.read(spark, f"file://{tmp_path}/db")
    assert back.global_id == "derived" and back.connections.count() == snap.connections.count() == 593
    assert back.connections.columns == snap.connections.columns
    plan = back.connections.where("dep_time >= 1706000000")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(dep_time), GreaterThanOrEqual(dep_time,1706000000)]" in plan
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    writer = store.writer()
    with pytest.raises(snapshots.Busy):
        store.writer()
    first = writer.add("connections", snap.connections).add("stops", snap.stops).close("x")
    change = snap.connections.limit(1).withColumn("travel_time", F.lit(1))
    second = store.writer().add("connections", change).close()
    assert store.versions() == [0, 1] and first.connections.where("travel_time = 1").count() == 0
    assert second.connections.where("travel_time = 1").count() == 1 and second.connections.count() == 593
    sinks.write_csv(sinks.stops_table(snap), f"file://{tmp_path}/stops")
    assert spark.read.csv(f"file://{tmp_path}/stops", header=True).columns == ["globalId", "Latitude", "Longitude", "name"]
    assert json.loads(sinks.tile_manifest(snap, "n", 3, 14))["maxzoom"] == 14
    assert sinks.map_ways(snap).count() > 0 and sinks.map_nodes(snap).count() == 25
    assert sinks.connections_table(snap, human=True).columns[2] == "departure"
    assert sinks.show_info(snap).count() == 1 and sinks.as_json_lines(snap.stops).count() == 25
    assert snapshots.default_name('a/b:c"', datetime(2020, 1, 6)) == "a_b_c_.2020-01-06.transitdb"


def test_windows(spark):
    own = lambda *w: spark.createDataFrame(list(w), "start_time bigint, end_time bigint")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(sets.window_difference(own((600, 630)), 585, 645)) == [(585, 600), (630, 645)]
    assert got(sets.window_difference(own((600, 630), (615, 645)), 585, 645)) == [(585, 600)]
    assert got(sets.window_union(own((0, 30), (15, 45), (-15, 45), (-60, -30), (-30, 0)))) == [(-60, 45)]
    assert got(sets.window_difference(own(), 1, 2)) == [(1, 2)]


def test_refresh(spark, tmp_path):
    base = derive.snapshot(spark, "/root/testdata/sf0.001")
    calls = []

    def load(writer, start, end):
        calls.append((start, end))
        if start == 3000:
            raise OSError("gone")
        writer.add("connections", base.connections.limit(3).withColumn("dep_time", F.lit(start).cast("bigint")))

    updater = refresh.Updater(snapshots.Store(spark, f"file://{tmp_path}/store"), load)
    assert updater.update(1000, 2000) == [(1000, 2000)] and updater.update(1000, 2000) == []
    assert updater.update(500, 2500) == [(500, 1000), (2000, 2500)] and updater.loaded == [(500, 2500)]
    with pytest.raises(OSError):
        updater.update(3000, 3100)
    assert updater.loaded == [(500, 2500)]
    updater.update(1000, 1100, refresh=True)
    assert calls[-1] == (1000, 1100)
    assert refresh.Updater(updater.store).update(0, 1) == []

    ran = []

    class Policy:
        def __init__(self, period):
            self.period = period

        def run(self, updater, now):
            ran.append((self.period, now))

    sync = refresh.Synchronizer(updater, [Policy(10), Policy(5)])
    assert sync.clock == 5 and sync.tick(1003) == 2 and sync.tick(1008) == 1 and sync.tick(1012) == 2
    assert ran == [(5, 1000), (10, 1000), (5, 1005), (5, 1010), (10, 1010)]
    sync.busy = True
    assert sync.tick(1015) == 0
    tries = []

    class Flaky:
        def update(self, start, end, again):
            tries.append((start, end))
            if len(tries) < 2:
                raise OSError

    refresh.Window(60, 100, 200, retries=3).run(Flaky(), 1000)
    assert tries == [(900, 1200)] * 2


def test_stream_of_changes(spark, tmp_path):
    base = derive.connections(spark, "/root/testdata/sf0.001")
    first = base.limit(20).withColumn("version", F.lit(1).cast("bigint"))
    first.unionByName(first.withColumns({"travel_time": F.lit(7), "version": F.lit(2).cast("bigint")})).write.parquet(f"{tmp_path}/in")
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    changes = refresh.connection_stream(spark, f"file://{tmp_path}/in")
    refresh.upsert_stream(changes, store, f"file://{tmp_path}/check").awaitTermination()
    got = store.latest().connections
    assert got.count() == 20 and got.where("travel_time = 7").count() == 20
    query = refresh.windowed_departures(changes).writeStream.format("memory").queryName("departures").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("departures").agg({"departures": "sum"}).first()[0] == 40


def test_geo(spark):
    rows = [("howest", 3.22121, 51.21538), ("sint-clara", 3.2227, 51.2153), ("station", 3.21782, 51.19723)]
    stops = spark.createDataFrame([(*r, None) for r in rows], STOPS)
    dist = {(r["from_stop"], r["to_stop"]): r["dist"] for r in geo.pairs_in_range(stops, stops, 5000.0).collect()}
    assert 100 <= dist["howest", "sint-clara"] <= 110 and 2000 <= dist["howest", "station"] <= 2100
    assert geo.find_closest(stops, 3.2213, 51.2154).first()["stop_id"] == "howest"
    assert geo.find_closest(stops, 3.0, 51.19723, 50.0).count() == 0
    # All pairs, in high latitudes too.
    import random

    rnd = random.Random(2)
    many = spark.createDataFrame([(str(k), rnd.uniform(3, 3.5), rnd.choice([0, 51, 70]) + rnd.uniform(-0.1, 0.1), None) for k in range(300)], STOPS)
    a, b = (many.select(F.col("stop_id").alias(f"i{x}"), F.col("lon").alias(f"x{x}"), F.col("lat").alias(f"y{x}")) for x in "ab")
    every = a.crossJoin(b).where(geo.distance_m(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")) <= 3000)
    assert geo.pairs_in_range(many, many, 3000.0).count() == every.count() > 400


def test_chained_hops(spark):
    rows = [("z", "b", "c", 100, 0, 100, 0, "t", None), ("y", "a", "b", 100, 0, 100, 0, "t", None), ("x", "c", "d", 100, 60, 160, 0, "t", None), ("w", "q", "r", 50, 10, 60, 0, "u", None)]
    from tramline.model import CONNECTIONS

    df = spark.createDataFrame(rows, CONNECTIONS)
    assert [r["conn_id"] for r in sets.sorted_connections(df).orderBy("seq").collect()] == ["w", "y", "z", "x"]
    validate.check_order(spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "seq int, dep_time int"), "seq")
    with pytest.raises(validate.NotSorted):
        validate.check_order(spark.createDataFrame([(0, 1), (1, 3), (2, 2)], "seq int, dep_time int"), "seq")


def test_parsers():
    assert [parsers.parse_duration(t) for t in ("1:30", "2 hours", "5", "x")] == [5400, 7200, 300, None]
    assert parsers.parse_time("2020-01-06_10:00:00/Europe/Brussels") == datetime(2020, 1, 6, 9, tzinfo=UTC)
    now = datetime(2020, 1, 6, 23, 30, tzinfo=UTC)
    assert parsers.parse_time("today", now) == datetime(2020, 1, 6, tzinfo=UTC) and parsers.parse_time("now", now) == now
    assert [parsers.parse_span(t, now) for t in ("1hour", "2days", "90")] == [3600, 172800, 90]
    assert parsers.parse_span("2020-01-07_00:30:00", now) == 3600
    assert parsers.easter(2020) == date(2020, 4, 12) and parsers.easter(2024) == date(2024, 3, 31)
    assert parsers.opening_hours_rule.parse("mo-fr 8:00-18:30") == [("range", ("weekday", 0), ("weekday", 4)), ("range", ("time", 480), ("time", 1110))]
    assert parsers.opening_hours_rule.parse('dec 25, "closed"') == [("date", (12, 25)), ("comment", "closed")]
    assert parsers.opening_hours_rule.parse("never") is None
    t = datetime(2020, 1, 31, 23, 59, tzinfo=UTC)
    assert parsers.Timed("day_of_month", 31).next(t) == datetime(2020, 3, 31, tzinfo=UTC)
    assert parsers.Timed("weekday", 0).next(t) == datetime(2020, 2, 3, tzinfo=UTC) and parsers.Timed("hour", 8).prev(t) == datetime(2020, 1, 31, 8, tzinfo=UTC)
    assert parsers.Timed("month", 2).then(parsers.Timed("time", 600), t) == datetime(2020, 2, 1, 10, tzinfo=UTC)
    assert parsers.Timed("easter").shifted(86400).next(t) == datetime(2020, 4, 13, tzinfo=UTC)
    assert (parsers.number.separated(parsers.literal(",")).check(lambda x: len(x) > 1) | parsers.integer.map(lambda x: [x])).parse("1,2.5") == [1.0, 2.5]


def test_command_line(spark, tmp_path):
    feed(tmp_path / "feed")
    lines = []
    state = cli.State(spark, out=lines.append)
    run = lambda *words: cli.execute(state, cli.parse(list(words)))
    run("--read-gtfs", f"{tmp_path}/feed", "start=2020-01-01", "duration=2days", "--select-time", "2020-01-01", "1day", "--validate", "--write-transit-db", f"{tmp_path}/out", "--show-info")
    assert state.snapshots[0].connections.count() == 1
    run("--clear", "--read", f"{tmp_path}/out", "--select-stop", "https://one.example/stop/1", "--remove-unused", "--write-routes")
    assert any("stop/1" in x for x in lines)
    run("--select-bounding-box", "-left", "2", "-right", "4", "-top", "52", "-bottom", "50", "--undo-delays", "--write-stops", f"{tmp_path}/stops.csv")
    run("--help", "--validate", "--timezone", "Europe/Brussels", "2020-01-06")
    assert any("in Europe/Brussels" in x for x in lines)
    cli._shell(state, {"input": ["write-routes", "nothing", "q"]})
    assert any("no switch" in x for x in lines)
    for bad in (["--nothing"], ["x"], ["--read"], ["--read", "a", "b"], ["--select-time", "a", "start=b"], ["--select-trip", "-what", "x"]):
        with pytest.raises(cli.UsageError):
            cli.parse(bad)
    with pytest.raises(cli.UsageError):
        cli.check(cli.parse(["--write-routes"]))
    with pytest.raises(cli.UsageError):
        cli.check(cli.parse(["--read", "x"]))
    assert timedelta(days=1) == cli.timedelta(days=1)
