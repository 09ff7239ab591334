"""The data model: four tables, a snapshot of them, and the meaning of a connection's mode."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = "operator_id string, attributes map<string,string>"
STOPS = "stop_id string, lon double, lat double, attributes map<string,string>"
TRIPS = "trip_id string, operator_id string, attributes map<string,string>"
CONNECTIONS = "conn_id string, dep_stop string, arr_stop string, dep_time bigint, travel_time int, arr_time bigint, mode smallint, trip_id string, attributes map<string,string>"
REQUESTS = "query_id int, from_stops array<string>, to_stops array<string>, start_time bigint, end_time bigint, max_walk_m int, transfer_s int, max_transfers int"
FOOTPATHS = "from_stop string, to_stop string, secs int"
WINDOWS = "start_time bigint, end_time bigint"
LEG = "struct<kind:string,conn_id:string,trip_id:string,from_stop:string,to_stop:string,dep:bigint,arr:bigint>"
JOURNEYS = f"query_id int, journey_id int, departure bigint, arrival bigint, vehicles int, travel_time bigint, walking_time double, legs array<{LEG}>"

#: Values of mode (fixed): both, get on only, get off only, neither; bit 4 marks a cancelled connection.
BOTH, GET_ON_ONLY, GET_OFF_ONLY, NEITHER, CANCELLED = 0, 1, 2, 3, 4


def can_get_on(mode: str | Column = "mode") -> Column:
    return (_column(mode) % 4).isin(BOTH, GET_ON_ONLY)


def can_get_off(mode: str | Column = "mode") -> Column:
    return (_column(mode) % 4).isin(BOTH, GET_OFF_ONLY)


def is_cancelled(mode: str | Column = "mode") -> Column:
    return _column(mode).bitwiseAND(CANCELLED) != 0


def create_mode(get_on: Column, get_off: Column, cancelled: Column | None = None) -> Column:
    """The mode of the given permissions; a null permission counts as given."""
    on, off = F.coalesce(get_on, F.lit(True)), F.coalesce(get_off, F.lit(True))
    bits = F.when(on & off, BOTH).when(on, GET_ON_ONLY).when(off, GET_OFF_ONLY).otherwise(NEITHER)
    extra = F.when(F.coalesce(cancelled, F.lit(False)), CANCELLED).otherwise(0) if cancelled is not None else F.lit(0)
    return (bits + extra).cast("smallint")


def attribute(key: str, default: str | None = None, column: str = "attributes") -> Column:
    """An attribute's value, or the default."""
    found = F.col(column)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def stop_name(column: str = "attributes") -> Column:
    return attribute("name", "", column)


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def connection_errors(connections: DataFrame) -> DataFrame:
    """Connections that the model forbids: a departure at epoch 0 or before, a negative travel time, or an arrival that is not their sum."""
    return connections.where((F.col("dep_time") <= 0) | (F.col("travel_time") < 0) | (F.col("arr_time") != F.col("dep_time") + F.col("travel_time")))


@dataclass(frozen=True)
class Snapshot:
    """An immutable version of a timetable: four DataFrames, an id and attributes."""

    operators: DataFrame
    stops: DataFrame
    trips: DataFrame
    connections: DataFrame
    global_id: str = ""
    meta: dict[str, str] = field(default_factory=dict)

    def with_tables(self, **tables: DataFrame) -> Snapshot:
        return replace(self, **tables)

    def operator(self, operator_id: str) -> DataFrame:
        return self.operators.where(F.col("operator_id") == operator_id)

    def stop(self, stop_id: str) -> DataFrame:
        return self.stops.where(F.col("stop_id") == stop_id)

    def trip(self, trip_id: str) -> DataFrame:
        return self.trips.where(F.col("trip_id") == trip_id)

    def date_range(self) -> DataFrame:
        """One row: earliest and latest departure."""
        return self.connections.agg(F.min("dep_time").alias("earliest"), F.max("dep_time").alias("latest"))


def empty_snapshot(spark, global_id: str = "") -> Snapshot:
    return Snapshot(*(spark.createDataFrame([], s) for s in (OPERATORS, STOPS, TRIPS, CONNECTIONS)), global_id)


def all_of(*conditions: Column | None) -> Column | None:
    """The conjunction of the conditions given; None stands for no condition."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else None
