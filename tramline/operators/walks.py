"""Walks and transfers between stops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import pairs_in_range


@dataclass(frozen=True)
class CrowFlight:
    """Straight walks up to a distance; as in the model the time is the distance times seconds_per_metre."""

    max_metres: float = 500.0
    seconds_per_metre: float = 1.4

    @property
    def range_m(self) -> float:
        return self.max_metres

    def identifier(self) -> str:
        return f"crowsflight&maxDistance={self.max_metres:g}&speed={self.seconds_per_metre:g}"

    def times(self, pairs: DataFrame) -> Column:
        """Seconds for rows of (from_stop, to_stop, dist); null: no walk."""
        walk = F.floor(F.round(F.col("dist") * self.seconds_per_metre, 6)).cast("int")
        return F.when((F.col("dist") <= self.max_metres) & (F.col("from_stop") != F.col("to_stop")), walk)


@dataclass(frozen=True)
class InternalTransfer:
    """A fixed time within a stop, and no walk elsewhere."""

    secs: int = 180

    @property
    def range_m(self) -> float:
        return 0.0

    def identifier(self) -> str:
        return f"internalTransfer&timeNeeded={self.secs}"

    def times(self, pairs: DataFrame) -> Column:
        return F.when(F.col("from_stop") == F.col("to_stop"), F.lit(self.secs))


@dataclass(frozen=True)
class FirstLastMile:
    """One policy from the first stops, another to the last stops, a third elsewhere; a pair of both kinds follows the first."""

    default: CrowFlight | InternalTransfer
    first: CrowFlight | InternalTransfer
    last: CrowFlight | InternalTransfer
    first_stops: Sequence[str] = field(default_factory=tuple)
    last_stops: Sequence[str] = field(default_factory=tuple)

    @property
    def range_m(self) -> float:
        return max(p.range_m for p in (self.default, self.first, self.last))

    def identifier(self) -> str:
        return "firstLastMile&" + "&".join(f"{k}={quote(p.identifier(), safe='')}" for k, p in (("default", self.default), ("firstMile", self.first), ("lastMile", self.last)))

    def times(self, pairs: DataFrame) -> Column:
        own = F.when(F.col("from_stop").isin(list(self.first_stops)), F.struct(self.first.times(pairs).alias("t")))
        own = own.when(F.col("to_stop").isin(list(self.last_stops)), F.struct(self.last.times(pairs).alias("t")))
        return own.otherwise(F.struct(self.default.times(pairs).alias("t")))["t"]


Generator = CrowFlight | InternalTransfer | FirstLastMile


def generator_of(identifier: str) -> Generator:
    """The generator that an identifier names."""
    kind, *parts = identifier.split("&")
    given = dict(p.split("=", 1) for p in parts)
    if kind == "crowsflight":
        return CrowFlight(float(given["maxDistance"]), float(given["speed"]))
    if kind == "internalTransfer":
        return InternalTransfer(int(given["timeNeeded"]))
    if kind == "firstLastMile":
        return FirstLastMile(*(generator_of(unquote(given[k])) for k in ("default", "firstMile", "lastMile")))
    raise ValueError(f"no walk generator is named {kind}")


def footpaths(stops: DataFrame, generator: Generator, others: DataFrame | None = None) -> DataFrame:
    """(from_stop, to_stop, secs) of all walks from stops to others, by the generator; pairs out of range are never built."""
    other = stops if others is None else others
    if generator.range_m <= 0:
        pairs = stops.select(F.col("stop_id").alias("from_stop")).join(other.select(F.col("stop_id").alias("to_stop")), F.col("from_stop") == F.col("to_stop")).withColumn("dist", F.lit(0.0))
    else:
        pairs = pairs_in_range(stops, other, generator.range_m)
    return pairs.withColumn("secs", generator.times(pairs)).where("secs IS NOT NULL").select("from_stop", "to_stop", F.col("secs").cast("int").alias("secs"))


def walk_away(reached: DataFrame, paths: DataFrame, window_end: int) -> DataFrame:
    """From (stop, arrival): all stops reached by one walk before the window ends, each at its earliest."""
    walked = reached.join(paths, reached["stop"] == paths["from_stop"]).select(F.col("to_stop").alias("stop"), (F.col("arrival") + F.col("secs")).alias("arrival"))
    return walked.where(F.col("arrival") <= window_end).groupBy("stop").agg(F.min("arrival").alias("arrival"))


def walk_towards(reaching: DataFrame, paths: DataFrame, window_start: int) -> DataFrame:
    """To (stop, departure): all stops from which one walk arrives in time, each at its latest."""
    walked = reaching.join(paths, reaching["stop"] == paths["to_stop"]).select(F.col("from_stop").alias("stop"), (F.col("departure") - F.col("secs")).alias("departure"))
    return walked.where(F.col("departure") >= window_start).groupBy("stop").agg(F.max("departure").alias("departure"))
