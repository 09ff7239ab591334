"""Unions of snapshots, upserts, orders, and sets of time windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Snapshot

KEYS = {"operators": "operator_id", "stops": "stop_id", "trips": "trip_id", "connections": "conn_id"}


def first_match(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of tables with source_id; of rows of one key the first source's."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("source_id", F.lit(i)) for i, t in enumerate(tables)])
    order = Window.partitionBy(key).orderBy("source_id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def merge(snapshots: Sequence[Snapshot]) -> Snapshot:
    """One snapshot of several: rows of the first source win; ids must differ and are joined with ';'."""
    ids = [s.global_id for s in snapshots]
    if len(set(ids)) < len(ids):
        raise ValueError("two sources have the same id")
    tables = {name: first_match([getattr(s, name) for s in snapshots], key).drop("source_id") for name, key in KEYS.items()}
    return Snapshot(**tables, global_id=";".join(ids), meta={k: v for s in reversed(snapshots) for k, v in s.meta.items()})


def merged_scan(tables: Sequence[DataFrame], backward: bool = False) -> DataFrame:
    """Connections of all sources in order of departure, with source_id."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("source_id", F.lit(i)) for i, t in enumerate(tables)])
    order = ["dep_time", "source_id", "conn_id"]
    return rows.orderBy(*[F.desc(c) if backward else F.asc(c) for c in order])


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """base with the rows of changes inserted or put in place of those of their key; of several changes of a key the highest version."""
    old = base.withColumn(version, F.lit(-1).cast("bigint")).withColumn("_old", F.lit(1))
    new = changes.withColumn(version, F.col(version).cast("bigint")).withColumn("_old", F.lit(0))
    order = Window.partitionBy(key).orderBy("_old", F.desc(version))
    rows = new.unionByName(old)
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "_old", version).select(*base.columns)


#: Ranges that a running value over all rows is found in: rows meet range by range, and one row a range in one task.
RANGES = 4096


def ranged(rows: DataFrame, column: str) -> DataFrame:
    """rows with range: which of RANGES equal ranges of the column a row lies in."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // RANGES))
    return rows.withColumn("range", F.floor((F.col(column) - (low or 0)) / width))


def numbered(rows: DataFrame, column: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """rows with their number from 1 in an order that begins with the column (a whole number)."""
    rows = ranged(rows, column)
    inner = rows.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return inner.join(sizes, "range").withColumn(name, F.col("before") + F.col("nth")).drop("range", "nth", "before")


def window_union(windows: DataFrame) -> DataFrame:
    """Overlapping or touching windows as one. A window is new where it starts after all before it have ended; windows alike count once."""
    rows = ranged(windows.select("start_time", "end_time").distinct(), "start_time")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("range").agg(F.max("end_time").alias("most")).select("range", F.max("most").over(upto).alias("reached"))
    inner = Window.partitionBy("range").orderBy("start_time", "end_time")
    reach = F.greatest("reached", F.max("end_time").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(ends, "range").withColumn("new", F.when(F.col("start_time") <= reach, 0).otherwise(1))
    counts = rows.groupBy("range").agg(F.sum("new").alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    island = F.col("before") + F.sum("new").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(counts, "range").withColumn("island", island)
    return rows.groupBy("island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("island")


def window_difference(loaded: DataFrame, start: int, end: int) -> DataFrame:
    """The parts of [start, end) that no loaded window covers."""
    inside = loaded.where((F.col("end_time") > start) & (F.col("start_time") < end)).select(F.greatest("start_time", F.lit(start)).alias("start_time"), F.least("end_time", F.lit(end)).alias("end_time"))
    edge = loaded.sparkSession.createDataFrame([(start, start), (end, end)], "start_time bigint, end_time bigint")
    # Windows of the union are apart: the next starts in the same range, or is the first of the next range that has any.
    rows = ranged(window_union(inside.unionByName(edge)), "start_time")
    heads = rows.groupBy("range").agg(F.min("start_time").alias("head"))
    heads = heads.select("range", F.min("head").over(Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)).alias("head"))
    inner = Window.partitionBy("range").orderBy("start_time", "end_time")
    rows = rows.withColumn("next", F.lead("start_time").over(inner)).join(heads, "range").withColumn("next", F.coalesce("next", "head"))
    return rows.where("next > end_time").select(F.col("end_time").alias("start_time"), F.col("next").alias("end_time"))


def connection_order(connections: DataFrame) -> DataFrame:
    """Connections with seq: by departure; hops of one trip that leave at the same time are chained, each from where the last arrived.

    Such hops are few; a hop's place is the number of hops before it on the chain, found by joining a hop to the one it follows. Where the
    chain is not one line (a ring, a fork), ids decide.
    """
    twins = connections.groupBy("trip_id", "dep_time").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = connections.join(twins, ["trip_id", "dep_time"]).groupBy("trip_id", "dep_time").agg(F.sort_array(F.collect_list(F.struct("conn_id", "dep_stop", "arr_stop"))).alias("hops"))
    head = F.filter("hops", lambda h: ~F.exists("hops", lambda g: g["arr_stop"] == h["dep_stop"]))
    start = F.struct(F.get(head, 0)["dep_stop"].alias("at"), F.expr("cast(array() as array<string>)").alias("ids"))

    def follow(acc, _):
        nxt = F.get(F.filter("hops", lambda h: (h["dep_stop"] == acc["at"]) & ~F.array_contains(acc["ids"], h["conn_id"])), 0)
        return F.when(nxt.isNull(), acc).otherwise(F.struct(nxt["arr_stop"].alias("at"), F.concat(acc["ids"], F.array(nxt["conn_id"])).alias("ids")))

    chain = own.withColumn("ids", F.when(F.size(head) == 1, F.aggregate("hops", start, follow)["ids"]))
    # A chain that misses a hop is ambiguous.
    chain = chain.where(F.size("ids") == F.size("hops")).select(F.posexplode("ids").alias("rank", "conn_id"))
    ranked = connections.join(chain, "conn_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    return ranked.orderBy("dep_time", "trip_id", "rank", "conn_id")


def sorted_connections(connections: DataFrame) -> DataFrame:
    """(conn_id, dep_time, seq) for connections in their order; seq counts from 0. Ranks are taken in ranges of departure, not in one task."""
    ranked = numbered(connection_order(connections), "dep_time", ["dep_time", "trip_id", "rank", "conn_id"], "seq")
    return ranked.select("conn_id", "dep_time", (F.col("seq") - 1).alias("seq"))
