"""Scan kernels, rounds and the planner on small timetables with known answers, and against each other."""
import random

import pytest
from pyspark.sql import functions as F

from tramline import derive
from tramline.model import CONNECTIONS, OPERATORS, STOPS, TRIPS, Snapshot
from tramline.operators import filters, journeys, pareto, walks
from tramline.plans import kernel, rounds
from tramline.plans.planner import FRONTIER, InvalidRequest, Planner, Profile, _answer, plan

SF = "/root/testdata/sf0.01"
DAY = 1705276800
T0 = 1543940400  # 2018-12-04 16:20 UTC


def row(i, a, b, dep, took, trip, mode=0):
    return (str(i), a, b, dep, dep + took, mode, str(trip))


BASIC = [
    row(0, "00", "01", T0, 600, 0), row(1, "01", "02", T0 + 780, 600, 1), row(3, "02", "03", T0 + 1560, 600, 1), row(2, "01", "03", T0 + 900, 2400, 0),
    row(4, "10", "11", T0 + 25800, 120, 100), row(5, "11", "10", T0 + 29400, 120, 100),
]


def test_earliest_arrival():
    table = kernel.Timetable.of(BASIC)
    assert kernel.earliest_arrival(table, ["00"], ["01"], T0 - 1200, T0 + 9600)[-1][1] == "0"
    assert kernel.earliest_arrival(table, ["00"], ["02"], T0 - 1200, T0 + 9600)[-1][1] == "1"
    assert kernel.earliest_arrival(table, ["03"], ["00"], T0 - 1200, T0 + 9600) is None


def test_modes():
    table = kernel.Timetable.of([row(0, "0", "1", 1000, 100, 7, 1), row(1, "1", "2", 1200, 100, 7, 2)])
    ask = lambda a, b: kernel.earliest_arrival(table, [a], [b], 900, 3000)
    assert ask("0", "1") is None and ask("1", "0") is None
    assert [x[1] for x in ask("0", "2")] == ["0", "1"]
    shut = kernel.Timetable.of([row(0, "0", "1", 1000, 100, 7, 3), row(1, "1", "2", 1200, 100, 7, 3)])
    assert kernel.earliest_arrival(shut, ["0"], ["2"], 900, 3000) is None
    gone = kernel.Timetable.of([row(0, "0", "1", 1000, 100, 7, 4)])
    assert kernel.earliest_arrival(gone, ["0"], ["1"], 900, 3000) is None


def test_no_detour():
    table = kernel.Timetable.of([row(0, "dep", "detour", 1000, 100, 0), row(1, "detour", "dep", 1500, 100, 1), row(2, "dep", "arr", 1700, 100, 1)])
    assert [x[1] for x in kernel.earliest_arrival(table, ["dep"], ["arr"], 1000, 2000)] == ["2"]


def test_all_journeys():
    ask = lambda rows, a, b, **k: kernel.all_journeys(kernel.Timetable.of(rows), [a], [b], 0, 10**10, **k)
    one = ask([row(0, "a", "b", 1000, 1800, 0), row(1, "a", "b", 1000, 2400, 1)], "a", "b")
    assert [j[0][1] for j in one] == ["0"]
    change = ask([row(0, "a", "b", 1000, 100, 0), row(1, "b", "c", 1500, 100, 1)], "a", "c")
    assert [[x[0] for x in j] for j in change] == [["ride", "transfer", "ride"]]
    stay = ask([row(0, "a", "b", 1000, 100, 0), row(1, "b", "c", 1500, 100, 0)], "a", "c")
    assert [[x[0] for x in j] for j in stay] == [["ride", "ride"]]
    assert ask([row(0, "a", "b", 1000, 100, 0)], "b", "a") == []
    # Too short to change, unless the transfer is not enforced.
    short = [row(0, "a", "b", 1000, 100, 0), row(1, "b", "c", 1150, 100, 1)]
    assert ask(short, "a", "c") == [] and len(ask(short, "a", "c", legacy_transfer=True)) == 1
    assert ask([row(0, "a", "b", 1000, 100, 0), row(1, "b", "c", 1500, 100, 1)], "a", "c", max_vehicles=1) == []


def test_families_of_alternatives():
    line = lambda name, first, last, base: [row(f"{name}{i}", str(i), str(i + 1), base + 60 * i, 60, name) for i in range(first, last)]
    rows = line("A", 0, 3, 1000) + line("B", 2, 6, 1240) + line("C", 5, 8, 1241)
    found = kernel.all_journeys(kernel.Timetable.of(rows), ["0"], ["8"], 0, 2000, transfer=0)
    assert len(found) == 4 and {(j[0][5], j[-1][6]) for j in found} == {(1000, 1721)}


@pytest.fixture(scope="module")
def derived(spark):
    snap = derive.snapshot(spark, SF)
    w = rounds.in_window(snap.connections, DAY, DAY + 86400)
    paths = walks.footpaths(snap.stops, walks.CrowFlight())
    table = kernel.Timetable.of([tuple(r) for r in w.collect()], [tuple(r) for r in paths.collect()])
    return snap, table, paths


def origin(spark, *stops):
    return spark.createDataFrame([(0, s) for s in stops], "query_id int, stop string")


def test_golden_isochrones(spark, derived):
    snap, table, paths = derived
    labels = rounds.earliest_arrivals(snap.connections, origin(spark, "stop/0"), DAY, DAY + 86400).collect()
    times = [r["arrival"] - DAY for r in labels]
    assert (len(times), sum(times), max(times)) == (23, 905011, 84099)
    back = rounds.latest_departures(snap.connections, origin(spark, "stop/0"), DAY, DAY + 86400).collect()
    times = [DAY + 86400 - r["departure"] for r in back]
    assert (len(times), sum(times), max(times)) == (23, 1161780, 81071)
    walked = rounds.earliest_arrivals(snap.connections, origin(spark, "stop/0"), DAY, DAY + 86400, footpaths=paths).collect()
    times = [r["arrival"] - DAY for r in walked]
    assert (len(times), sum(times), max(times)) == (25, 174903, 19454)
    own = kernel.Timetable(table.rows, {})
    _, best = kernel.scan(own, ["stop/0"], [], DAY, DAY + 86400, 180)
    assert {s: n.time for s, n in best.items()} == {r["stop"]: r["arrival"] for r in labels}
    _, best = kernel.scan(table, ["stop/0"], [], DAY, DAY + 86400, 180)
    assert {s: n.time for s, n in best.items()} == {r["stop"]: r["arrival"] for r in walked}


def test_golden_profile(spark, derived):
    snap, table, _ = derived
    found = rounds.profiles(snap.connections, ["stop/0"], DAY, DAY + 86400).collect()
    assert (len(found), len({r["stop"] for r in found}), sum(r["vehicles"] for r in found), sum(r["arr"] - r["dep"] for r in found), max(r["vehicles"] for r in found)) == (39, 22, 74, 1128504, 4)
    own = kernel.profile_scan(kernel.Timetable(table.rows, {}), ["stop/0"], DAY, DAY + 86400)
    assert {(s, e.dep, e.arr, e.vehicles) for s, es in own.items() for e in es} == {tuple(r) for r in found}


def test_scans_agree_with_each_other(derived):
    _, table, _ = derived
    rnd = random.Random(3)
    for _ in range(12):
        a, b = (f"stop/{k}" for k in rnd.sample(range(25), 2))
        first = kernel.earliest_arrival(table, [a], [b], DAY, DAY + 86400)
        every = kernel.all_journeys(table, [a], [b], DAY, DAY + 86400)
        last = kernel.latest_departure(table, [a], [b], DAY, DAY + 86400)
        if first is None or not every:
            continue
        assert first[-1][6] <= min(j[-1][6] for j in every)
        assert last[0][5] >= max(j[0][5] for j in every)
        late = kernel.latest_departure(table, [a], [b], DAY, first[-1][6])
        assert late is None or (late[-1][6] <= first[-1][6] and late[0][5] >= first[0][5])
        for j in [first, last, *every]:
            assert all(x[4] == y[3] and x[6] <= y[5] for x, y in zip(j, j[1:])), j


def test_planner(spark, derived):
    snap, _, _ = derived
    plan = Planner(snap, Profile(walks=walks.InternalTransfer())).between("stop/1", "stop/0").window(DAY, DAY + 86400)
    labels = {r["stop"]: r["arrival"] for r in plan.isochrone_from().collect()}
    first = plan.earliest_arrival().collect()
    assert first[0]["arrival"] == labels["stop/0"] and first[0]["legs"][0]["from_stop"] == "stop/1" and first[0]["legs"][-1]["to_stop"] == "stop/0"
    every = plan.all_journeys().collect()
    tuples = {tuple(r)[1:] for r in plan.at("stop/0").profile_to().where("stop = 'stop/1'").collect()}
    assert {(r["departure"], r["arrival"], r["vehicles"]) for r in every} == tuples
    thin = plan.with_isochrone_filter()
    assert thin.connections_of_use().count() < snap.connections.count()
    assert {(r["departure"], r["arrival"], r["vehicles"]) for r in thin.all_journeys().collect()} == tuples
    last = plan.latest_departure().collect()
    assert last[0]["departure"] == max(t[0] for t in tuples)
    assert thin.filtered and not thin.reset_filter().filtered
    walk = Planner(snap).between("stop/0", "stop/1").direct().collect()
    assert [(r["from_stop"], r["to_stop"]) for r in walk] == [("stop/0", "stop/1")]
    with pytest.raises(InvalidRequest):
        Planner(snap).between("stop/0", "stop/0").window(DAY, DAY + 1).check()
    with pytest.raises(InvalidRequest):
        Planner(snap).between("stop/0", "stop/1").window(DAY, DAY).check()
    with pytest.raises(filters.UnknownId):
        Planner(snap).between("stop/0", "nowhere").window(DAY, DAY + 1).check()


def test_requests_beyond_the_kernel_go_by_rounds(spark, derived, monkeypatch):
    from tramline.plans import planner as module

    snap, _, _ = derived
    plan = Planner(snap).between("stop/1", "stop/0").window(DAY, DAY + 86400)
    near = plan.earliest_arrival().first()["arrival"]
    late = plan.latest_departure().first()["departure"]
    monkeypatch.setattr(module, "KERNEL_BYTES", 10)
    assert plan.earliest_arrival().first()["arrival"] == near
    assert plan.latest_departure().first()["departure"] == late


@pytest.mark.parametrize("most", [None, 1])
def test_all_journeys_do_not_depend_on_the_kernels_rows(spark, derived, monkeypatch, most):
    from tramline.plans import planner as module

    snap, _, _ = derived
    plan = Planner(snap, Profile(max_transfers=most)).between("stop/1", "stop/0").window(DAY, DAY + 86400)
    asks = (plan.all_journeys, plan.earliest_arrival, plan.latest_departure)
    near = [[tuple(r) for r in ask().collect()] for ask in asks]
    monkeypatch.setattr(module, "KERNEL_BYTES", 10)
    beyond = [[tuple(r) for r in ask().collect()] for ask in asks]
    assert sorted(map(str, beyond[0])) == sorted(map(str, near[0])) and len(near[0]) > 1
    assert [x[0][2:4] for x in beyond[1:]] == [x[0][2:4] for x in near[1:]] and all(x[0][-1] for x in beyond[1:])


def test_metrics(spark):
    def journey(*legs):
        none = F.lit(None).cast("string")
        return journeys.legs_array(*[journeys.leg(k, F.lit(c), F.lit(t) if t else none, F.lit(a), F.lit(b), F.lit(d), F.lit(r)) for k, c, t, a, b, d, r in legs])

    def m(*legs):
        return tuple(spark.range(1).select(journeys.metric(journey(*legs)).alias("m")).first()["m"])

    first = ("ride", "x", "0", "a", "b", 1000, 1120)
    assert m(first, ("ride", "y", "0", "b", "c", 1180, 1780)) == (1, 780, 0.0)
    assert m(first, ("ride", "y", "1", "b", "c", 1180, 1780)) == (2, 780, 0.0)
    assert m(("walk", None, None, "z", "a", 900, 1000), first) == (1, 220, 100.0)
    legs = journey(first, ("ride", "y", "1", "b", "a", 1180, 1780))
    out = spark.range(1).select(journeys.has_loop(legs).alias("loop"), journeys.last_trip_id(legs).alias("t"), F.size(journeys.chain_special(legs, "walk", F.lit("q"), F.lit(60))).alias("n")).first()
    assert tuple(out) == (True, "1", 3)


def test_frontier(spark):
    rows = [("s", 10, 20, 1), ("s", 10, 20, 1), ("s", 5, 25, 1), ("s", 5, 18, 1), ("s", 12, 22, 2), ("s", 12, 30, 1), ("t", 1, 99, 3)]
    got = {tuple(r) for r in pareto.prune(spark.createDataFrame(rows, "stop string, dep int, arr int, vehicles int")).collect()}
    assert got == {("s", 10, 20, 1), ("s", 5, 18, 1), ("s", 12, 22, 2), ("s", 12, 30, 1), ("t", 1, 99, 3)}


def test_families(spark):
    legs = "array(struct('ride' AS kind, 'c' AS conn_id, 't' AS trip_id, 'a' AS from_stop, 'b' AS to_stop, CAST(0 AS BIGINT) AS dep, CAST(0 AS BIGINT) AS arr))"
    df = spark.sql(f"SELECT 0 AS query_id, j AS journey_id, d AS departure, d AS arrival, 1 AS vehicles, 0 AS travel_time, w AS walking_time, {legs} AS legs FROM VALUES (0, 1000, 5.0D), (1, 1000, 9.0D), (2, 2000, 0.0D) v(j, d, w)")
    assert sorted(r["journey_id"] for r in pareto.prune_families(df).collect()) == [1, 2]
    assert sorted(r["leaves"] for r in pareto.partition_families(df).collect()) == [1, 2]


def test_walk_policies(spark):
    stops = spark.createDataFrame([(f"{k}", 3.0 + k * 1e-5, 51.0, None) for k in range(3)], STOPS)
    fixed = lambda s: walks.CrowFlight(500.0, s)
    policy = walks.FirstLastMile(fixed(10.0), fixed(20.0), fixed(30.0), ("1",), ("2",))
    got = {(r["from_stop"], r["to_stop"]): r["secs"] for r in walks.footpaths(stops, policy).collect()}
    near = got[("0", "1")] / 10
    kinds = {p: round(v / near / (2 if set(p) == {"0", "2"} else 1) / 10) for p, v in got.items()}
    assert kinds[("0", "1")] == 1 and kinds[("1", "0")] == 2 and kinds[("2", "1")] == 1 and kinds[("0", "2")] == 3 and kinds[("1", "2")] == 2
    again = walks.generator_of(policy.identifier())
    assert again.first == policy.first and again.identifier() == policy.identifier()


def test_snapshot_of_nothing(spark):
    snap = Snapshot(*(spark.createDataFrame([], s) for s in (OPERATORS, STOPS, TRIPS, CONNECTIONS)))
    with pytest.raises(filters.EmptyResult):
        filters.select_time(snap, 0, 1, allow_empty=False)
    with pytest.raises(filters.UnknownId):
        filters.select_stops(snap, "x")


def test_empty_tables(spark):
    none = derive.connections(spark, "/root/testdata/sf0.001").limit(0)
    assert rounds.earliest_arrivals(none, origin(spark), DAY, DAY + 1).count() == 0
    assert rounds.latest_departures(none, origin(spark, "stop/0"), DAY, DAY + 1).count() == 1
    assert rounds.profiles(none, ["stop/0"], DAY, DAY + 1).count() == 0


def crowd(stops=6, trips=60, seed=5):
    """Trips of three hops each over a few stops, modes mixed, times in whole minutes so that many are alike."""
    rnd = random.Random(seed)
    rows = []
    for t in range(trips):
        at, stop = 60 * rnd.randrange(600), rnd.randrange(stops)
        for _ in range(3):
            to, took = rnd.choice([s for s in range(stops) if s != stop]), 60 * rnd.randrange(1, 30)
            rows.append(row(len(rows), str(stop), str(to), at, took, t, rnd.choice([0, 0, 0, 1, 2, 3, 4])))
            at, stop = at + took + 60 * rnd.randrange(5), to
    return rows


WALKS = [("1", "0", 240), ("2", "3", 120), ("3", "2", 120), ("4", "4", 180)]


@pytest.mark.parametrize("options", [{}, {"max_vehicles": 2}, {"legacy_transfer": True}, {"keep": lambda dep, arr, vehicles: arr - dep < 6000}])
def test_the_frontier_is_that_of_all_journeys(options):
    for seed in range(8):
        table = kernel.Timetable.of(crowd(seed=seed), WALKS)
        ways = kernel.profile_scan(table, ["0"], 0, 40000, **options)
        values = kernel.frontier_scan(table, ["0"], 0, 40000, **options)
        assert values == {s: [(e.dep, e.arr, e.vehicles) for e in es] for s, es in ways.items()} and len(values) == 5


def requests_to_zero(spark, stops, end):
    return spark.createDataFrame([(k, [str(k)], ["0"], 1, end) for k in stops], "query_id int, from_stops array<string>, to_stops array<string>, start_time bigint, end_time bigint")


@pytest.fixture(scope="module")
def copies(spark):
    """A timetable of 40 copies of four trips in a chain: 40 ** 4 equally good journeys from the first stop."""
    rows = [(f"{i}/{c}", str(i), str(i - 1), 1000 * (9 - i), 500, 1000 * (9 - i) + 500, 0, f"trip/{i}/{c}", {}) for i in range(4, 0, -1) for c in range(40)]
    made = spark.createDataFrame(rows, CONNECTIONS)
    stops = spark.createDataFrame([(str(k), 3.0 + k, 51.0, None) for k in range(5)], STOPS)
    return Snapshot(spark.createDataFrame([], OPERATORS), stops, spark.createDataFrame([], TRIPS), made)


ALONG = {(k, 1000 * (9 - k), 8500, k) for k in range(1, 5)}


@pytest.mark.parametrize("most_bytes", [None, 0])
def test_equally_good_journeys_count_once(spark, copies, most_bytes):
    # Spelled out, they are 2.6 million.
    own = Planner(copies, Profile(walks=walks.InternalTransfer()))
    found = plan(requests_to_zero(spark, range(1, 5), 9000), own, "frontier", most_bytes).collect()
    assert {tuple(r) for r in found} == ALONG and len(found) == 4


def counted(monkeypatch, *names):
    """How often functions of the kernel are called."""
    n = dict.fromkeys(names, 0)
    for name in names:

        def own(*args, name=name, f=getattr(kernel, name), **options):
            n[name] += 1
            return f(*args, **options)

        monkeypatch.setattr(kernel, name, own)
    return n


def asks(froms, tos, end=40000):
    return [{"query_id": k, "from_stops": [a], "to_stops": [b], "start_time": 1, "end_time": end} for k, (a, b) in enumerate((a, b) for a in froms for b in tos if a != b)]


def test_requests_to_one_stop_share_the_scans_of_use(spark, monkeypatch):
    for seed in range(6):
        table = kernel.Timetable.of(crowd(seed=seed), WALKS)
        requests = asks("12345", "0")
        whole = _answer(Profile(), "frontier", False, FRONTIER)(table, requests)
        with monkeypatch.context() as m:
            n = counted(m, "scan", "frontier_scan")
            thin = _answer(Profile(), "frontier", True, FRONTIER)(table, requests)
        assert thin.equals(whole) and n == {"scan": 2, "frontier_scan": 1}
    assert not kernel.of_use(table, ["1"], ["0"], 1, 40000).all()


def test_a_journey_filter_counts_equally_good_journeys_once(spark, copies):
    own = Planner(copies, Profile(walks=walks.InternalTransfer(), journey_filter=lambda dep, arr, vehicles: vehicles <= 3))
    found = plan(requests_to_zero(spark, range(1, 5), 9000), own, "frontier").collect()
    assert {tuple(r) for r in found} == {x for x in ALONG if x[3] <= 3} and len(found) == 3


def test_requests_to_one_stop_share_one_frontier_scan(spark, monkeypatch):
    table = kernel.Timetable.of(crowd(trips=200), WALKS)
    n = counted(monkeypatch, "frontier_scan", "profile_scan")
    found = _answer(Profile(max_transfers=2), "frontier", False, FRONTIER)(table, asks("12345", "0")).to_pylist()
    assert n == {"frontier_scan": 1, "profile_scan": 0}
    every = {k: kernel.all_journeys(table, [str(k + 1)], ["0"], 1, 40000, max_vehicles=3) for k in range(5)}
    assert {tuple(r.values())[:3] for r in found} == {(k, j[0][5], j[-1][6]) for k, js in every.items() for j in js} and found


def test_latest_departures_to_one_stop_take_one_scan(spark, monkeypatch):
    for kind, froms, tos in (("latest", "12345", "0"), ("earliest", "0", "12345")):
        alone = kernel.latest_departure if kind == "latest" else kernel.earliest_arrival
        for seed in range(6):
            table = kernel.Timetable.of(crowd(seed=seed), WALKS)
            requests = asks(froms, tos)
            wanted = [alone(table, r["from_stops"], r["to_stops"], 1, 40000) for r in requests]
            with monkeypatch.context() as m:
                n = counted(m, "scan")
                found = _answer(Profile(), kind, False, "query_id int, journey_id int, legs array<struct<kind:string,conn_id:string,trip_id:string,from_stop:string,to_stop:string,dep:bigint,arr:bigint>>")(table, requests).to_pylist()
            assert {r["query_id"]: [tuple(x.values()) for x in r["legs"]] for r in found} == {k: w for k, w in enumerate(wanted) if w is not None} and found
            assert n == {"scan": 1} and table.mirrored() is table.mirrored()
