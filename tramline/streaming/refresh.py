"""Incremental refresh: loaded windows, gaps, policies, and streams of changed connections."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsers import clock_of_periods
from ..model import CONNECTIONS, WINDOWS, Snapshot
from ..operators.sets import upsert, window_difference, window_union
from ..sources.snapshots import Store, default_name, write
from ..storage import stored

Loader = Callable[[object, int, int], None]


@dataclass
class Updater:
    """Keeps what is loaded of a store. loader(writer, start, end) adds what a window holds; without one an update does nothing."""

    store: Store
    loader: Loader | None = None
    loaded: list[tuple[int, int]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def windows(self) -> DataFrame:
        return self.spark.createDataFrame(self.loaded, WINDOWS)

    def gaps(self, start: int, end: int) -> list[tuple[int, int]]:
        return [tuple(r) for r in window_difference(self.windows(), start, end).orderBy("start_time").collect()]

    def update(self, start: int, end: int, refresh: bool = False) -> list[tuple[int, int]]:
        """Loads the gaps of the window, or all of it; what was loaded is published even if a later gap fails."""
        if self.loader is None:
            return []
        todo = [(start, end)] if refresh else self.gaps(start, end)
        if not todo:
            return []
        done: list[tuple[int, int]] = []
        writer = self.store.writer()
        try:
            for gap in todo:
                self.loader(writer, *gap)
                done.append(gap)
        finally:
            writer.close()
            rows = self.spark.createDataFrame(self.loaded + done, WINDOWS)
            self.loaded = [tuple(r) for r in window_union(rows).orderBy("start_time").collect()]
        return done


@dataclass(frozen=True)
class Window:
    """Every period seconds, what lies from before to after seconds around now; a failed load is tried again, and success ends it."""

    period: int
    before: int
    after: int
    retries: int = 0
    refresh: bool = True

    def run(self, updater: Updater, now: int) -> None:
        for attempt in range(self.retries + 1):
            try:
                updater.update(now - self.before, now + self.after, self.refresh)
                return
            except Exception:
                if attempt == self.retries:
                    raise


@dataclass(frozen=True)
class WriteToDisk:
    """Every period seconds, the latest version to a folder."""

    period: int
    folder: str
    name: str = "latest"

    def run(self, updater: Updater, now: int) -> None:
        from datetime import datetime, timezone

        snap = updater.store.latest()
        if snap is not None:
            write(snap, f"{self.folder}/{default_name(self.name, datetime.fromtimestamp(now, timezone.utc))}-{now}")


#: What a synchronizer does when it is given nothing: once a minute, the next three hours.
DEFAULT = (Window(60, 0, 3 * 3600, refresh=False),)


class Synchronizer:
    """Runs policies on a clock that all their periods are multiples of: the most frequent first, all at the first tick."""

    def __init__(self, updater: Updater, policies: Sequence = DEFAULT):
        self.updater = updater
        self.policies = sorted(policies, key=lambda p: p.period)
        self.clock = clock_of_periods([p.period for p in policies])
        self.busy = False
        self.first = True

    def due(self, now: int) -> list:
        floored = now - now % self.clock
        return [p for p in self.policies if self.first or floored % p.period == 0]

    def tick(self, now: int | None = None) -> int:
        """Runs what is due and returns how many policies ran; a tick while another is at work is skipped."""
        if self.busy:
            return 0
        now = int(time.time()) if now is None else now
        own, self.busy = self.due(now), True
        try:
            for p in own:
                p.run(self.updater, now - now % self.clock)
        finally:
            self.busy, self.first = False, False
        return len(own)

    def run(self, ticks: int, sleep: Callable[[float], None] = time.sleep) -> None:
        for k in range(ticks):
            self.tick()
            if k + 1 < ticks:
                sleep(self.clock)


def latest_versions(changes: DataFrame, key: str = "conn_id", version: str = "version") -> DataFrame:
    """Of several versions of a key the highest; counted where rows are before they are dealt out."""
    columns = [c for c in changes.columns if c not in (key, version)]
    return changes.groupBy(key).agg(F.max(version).alias(version), *[F.max_by(c, version).alias(c) for c in columns])


def connection_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Changed connections as files arrive: the model's columns and a version."""
    return spark.readStream.schema(f"{CONNECTIONS}, version bigint").parquet(folder)


def upsert_stream(changes: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Publishes a version of the store for each batch of changes; a batch that is run again gives the same rows."""

    def publish(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        # The highest version of a batch counts, and goes over what is stored.
        rows = latest_versions(batch).drop("version").select(*changes.drop("version").columns)
        store.writer().add("connections", rows).close()

    writer = changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def windowed_departures(changes: DataFrame, late: str = "10 minutes", width: str = "15 minutes") -> DataFrame:
    """Departures per stop and window of time, over a stream or a table; a stream forgets windows that are later than late."""
    at = changes.withColumn("at", F.timestamp_seconds("dep_time"))
    timed = at.withWatermark("at", late) if changes.isStreaming else at
    return timed.groupBy(F.window("at", width), "dep_stop").agg(F.count("*").alias("departures")).select(F.unix_timestamp("window.start").alias("start_time"), "dep_stop", "departures")


def apply_updates(snap: Snapshot, changes: DataFrame) -> Snapshot:
    """A new snapshot with connections upserted by version; the old one stays as it was."""
    return snap.with_tables(connections=stored(upsert(snap.connections, changes, "conn_id"), "connections"))
