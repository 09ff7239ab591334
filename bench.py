"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line of warm seconds per query."""

from __future__ import annotations

import json
import os
import tempfile
import time
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tramline import derive
from tramline.operators import aggregates, filters, sets, validate, walks
from tramline.plans import rounds
from tramline.plans.planner import Planner, Profile, plan
from tramline.queries import END, QUERIES, START
from tramline.sources import gtfs

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def requests(spark: SparkSession, sources: int, targets: int):
    rows = [(a * 25 + b, [f"stop/{a}"], [f"stop/{b}"], START, END) for a in range(sources) for b in range(targets) if a != b]
    return spark.createDataFrame(rows, "query_id int, from_stops array<string>, to_stops array<string>, start_time bigint, end_time bigint")


def main() -> None:
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    snap = derive.snapshot(spark, SF)
    month = 1704067200, 1704067200 + 31 * 86400
    origin = spark.createDataFrame([(0, "stop/0")], "query_id int, stop string")
    planner = Planner(snap, Profile(walks=walks.CrowFlight()))
    all_ = spark.createDataFrame([(k, f"stop/{k}") for k in range(25)], "query_id int, stop string")

    cases = {
        "flt_select_time": lambda: filters.select_time(snap, START, END).connections,
        "agg_stop_stats": lambda: aggregates.stop_stats(snap),
        "agg_route_merge": lambda: aggregates.route_merge(snap.connections),
        "val_validate": lambda: validate.validate(snap),
        "win_next_departure": lambda: QUERIES["join_07_next_departure"](spark, SF),
        "set_connection_order": lambda: sets.sorted_connections(snap.connections),
        "src_gtfs_load": lambda: gtfs.load(derive.gtfs_feed(spark, SF), date(2020, 1, 6), date(2020, 1, 12)).connections,
        "join_tile_25_stops": lambda: walks.footpaths(snap.stops, walks.CrowFlight()),
        "join_tile_suppliers": lambda: QUERIES["join_04_suppliers_in_range"](spark, SF),
        "rte_04_rounds_day": lambda: rounds.earliest_arrivals(snap.connections, origin, START, END),
        "rte_04_rounds_month": lambda: rounds.earliest_arrivals(snap.connections, origin, *month),
        "rte_01_rounds_25_origins": lambda: rounds.earliest_arrivals(snap.connections, all_, START, END),
        "rte_06_profile_day": lambda: rounds.profiles(snap.connections, ["stop/0"], START, END),
        "rte_01_kernel_1": lambda: plan(requests(spark, 1, 2), planner, "earliest"),
        "rte_01_kernel_600": lambda: plan(requests(spark, 25, 25), planner, "earliest"),
        "rte_03_kernel_1": lambda: plan(requests(spark, 1, 2), planner, "all"),
        "rte_03_kernel_24": lambda: plan(requests(spark, 1, 25), planner, "all"),
        "rte_03_filtered": lambda: planner.between("stop/1", "stop/0").window(START, END).with_isochrone_filter().all_journeys(),
    }
    seconds = {}
    for name, case in cases.items():
        best = None
        for _ in range(REPEATS):
            began = time.time()
            case().write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    n = snap.connections.agg(F.count("*")).first()[0]
    print(json.dumps({"metric": "sum of best warm seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF.rsplit("sf", 1)[-1].strip("/"), "connections": n}))
    spark.stop()


if __name__ == "__main__":
    main()
