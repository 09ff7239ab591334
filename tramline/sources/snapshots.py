"""Snapshots as versioned Parquet folders: readers keep the version they opened, one writer publishes the next."""

from __future__ import annotations

import json
import re
import time
import uuid
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CONNECTIONS, OPERATORS, STOPS, TRIPS, Snapshot, empty_snapshot
from ..operators.sets import KEYS, upsert
from ..storage import exists, hadoop_path, write_text

SCHEMAS = {"operators": OPERATORS, "stops": STOPS, "trips": TRIPS, "connections": CONNECTIONS}


SMALL = ("operators", "stops", "trips")


def write(snap: Snapshot, path: str) -> None:
    """The four tables and the meta data; connections are written by service day, sorted, so that time filters skip files."""
    for name in SMALL:
        getattr(snap, name).write.parquet(f"{path}/{name}")
    write_connections(snap.connections, path)
    write_text(snap.connections.sparkSession, f"{path}/meta.json", json.dumps({"global_id": snap.global_id, "meta": snap.meta}))


def service_date(dep_time: str = "dep_time") -> Column:
    return F.to_date(F.timestamp_seconds(dep_time))


def write_connections(rows: DataFrame, path: str) -> None:
    rows.withColumn("service_date", service_date()).repartitionByRange("dep_time").sortWithinPartitions("dep_time").write.partitionBy("service_date").parquet(f"{path}/connections")


def read(spark: SparkSession, path: str) -> Snapshot:
    """A folder that was written as a whole, or a store's version, which names the folders that its parts are in."""
    meta = json.loads(_read_text(spark, f"{path}/meta.json"))
    parts = meta.get("parts") or {n: [f"{path}/{n}"] for n in SCHEMAS}
    tables = {}
    for n, schema in SCHEMAS.items():
        columns = [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")]
        tables[n] = spark.read.schema(schema).parquet(*parts[n]).select(*columns) if parts[n] else spark.createDataFrame([], schema)
    return Snapshot(**tables, global_id=meta["global_id"], meta=meta["meta"])


def default_name(name: str, at: datetime) -> str:
    return re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", f"{name}.{at.date().isoformat()}.transitdb")


def _read_text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] + "\n" for r in spark.read.text(path).collect())


class Busy(RuntimeError):
    """Another writer is at work."""


class Store:
    """A folder of versions v0, v1, ...; a version is seen when its meta file, written last, is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and exists(self.spark, f"{self.path}/{n}/meta.json"))

    def latest(self) -> Snapshot | None:
        found = self.versions()
        return read(self.spark, f"{self.path}/v{found[-1]}") if found else None

    def parts(self, version: int) -> dict[str, list[str]]:
        """The folders of a version's tables."""
        path = f"{self.path}/v{version}"
        meta = json.loads(_read_text(self.spark, f"{path}/meta.json"))
        return meta.get("parts") or {n: [f"{path}/{n}"] if n in SMALL else self.folders(f"{path}/{n}") for n in KEYS}

    def folders(self, path: str) -> list[str]:
        """The folders of service days under a path."""
        fs, p = hadoop_path(self.spark, path)
        return sorted(f"{path}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("service_date="))

    def writer(self) -> Writer:
        return Writer(self)


class Writer:
    """Gathers upserts and publishes them as the next version. Opening a second writer of a store raises Busy."""

    def __init__(self, store: Store):
        self.store = store
        self._fs, self._lock = hadoop_path(store.spark, f"{store.path}/writer.lock")
        try:
            # Made only if it is not there: of two writers one fails.
            write_text(store.spark, f"{store.path}/writer.lock", uuid.uuid4().hex, replace=False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise Busy(store.path) from None
        self.changes: dict[str, list] = {n: [] for n in KEYS}

    def add(self, table: str, rows) -> Writer:
        """Rows to insert, or to put in place of those of their id."""
        self.changes[table].append(rows)
        return self

    def close(self, global_id: str = "", meta: dict[str, str] | None = None) -> Snapshot:
        """Publishes; later additions win. Only what changed is written: a table without changes, and connections of a service day
        that no change touches, stay in the folders of the versions before. The lock goes even on failure.
        """
        try:
            spark, found = self.store.spark, self.store.versions()
            base = self.store.latest() or empty_snapshot(spark, global_id)
            old = self.store.parts(found[-1]) if found else {n: [] for n in KEYS}
            path = f"{self.store.path}/v{(found or [-1])[-1] + 1}"
            stale, p = hadoop_path(spark, path)
            stale.delete(p, True)
            parts = {}
            for name, key in KEYS.items():
                own = getattr(base, name)
                rows = [r.select(*own.columns).withColumn("version", F.lit(v)) for v, r in enumerate(self.changes[name])]
                if not rows:
                    parts[name] = old[name]
                elif name in SMALL:
                    upsert(own, reduce(DataFrame.unionByName, rows), key).write.parquet(f"{path}/{name}")
                    parts[name] = [f"{path}/{name}"]
                else:
                    parts[name] = self._connections(own, reduce(DataFrame.unionByName, rows), old[name], path)
            known = {**base.meta, **(meta or {}), "published": str(int(time.time()))}
            write_text(spark, f"{path}/meta.json", json.dumps({"global_id": global_id or base.global_id, "meta": known, "parts": parts}))
            return read(spark, path)
        finally:
            self._fs.delete(self._lock, False)

    def _connections(self, own: DataFrame, changes: DataFrame, old: list[str], path: str) -> list[str]:
        """Writes the service days of the changes, and those that a changed connection was on before. Days are few: the folders are listed."""
        days = changes.select(service_date().cast("string").alias("day"))
        if old:
            moved = own.select("conn_id", "dep_time").join(changes.select("conn_id"), "conn_id", "left_semi")
            days = days.unionByName(moved.select(service_date().cast("string").alias("day")))
        touched = {r["day"] for r in days.distinct().collect()}
        day = lambda folder: folder.rsplit("service_date=", 1)[1]
        folders = [f for f in old if day(f) in touched]
        spark = self.store.spark
        before = spark.read.schema(CONNECTIONS).parquet(*folders).select(*own.columns) if folders else own.limit(0)
        write_connections(upsert(before, changes, "conn_id"), path)
        return [f for f in old if day(f) not in touched] + self.store.folders(f"{path}/connections")
