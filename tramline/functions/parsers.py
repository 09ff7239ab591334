"""Durations, dates, map URLs and opening-hours terms, as column expressions and as plain functions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- durations ---------------------------------------------------------------------------------------------------------

_CLOCK = r"^\s*(\d+):(\d+)(?::(\d+))?\s*$"
_HOURS = r"^\s*(\d+)\s*(?:hours|hour|h)\s*$"
_MINUTES = r"^\s*(\d+)\s*(?:minutes|min|m)?\s*$"


def duration_seconds(text: Column) -> Column:
    """Seconds of 'h:m:s', 'h:m', 'N hours', 'N minutes' or bare minutes; null for anything else."""
    part = lambda rx, k: F.try_to_number(F.nullif(F.regexp_extract(text, rx, k), F.lit("")), F.lit("999999999")).cast("bigint")
    return (
        F.when(text.rlike(_CLOCK), part(_CLOCK, 1) * 3600 + part(_CLOCK, 2) * 60 + F.coalesce(part(_CLOCK, 3), F.lit(0)))
        .when(text.rlike(_HOURS), part(_HOURS, 1) * 3600)
        .when(text.rlike(_MINUTES), part(_MINUTES, 1) * 60)
    )


def parse_duration(text: str) -> int | None:
    if m := re.match(_CLOCK, text):
        return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)
    for rx, unit in ((_HOURS, 3600), (_MINUTES, 60)):
        if m := re.match(rx, text):
            return int(m[1]) * unit
    return None


def clock_seconds(text: Column) -> Column:
    """Seconds of 'HH:MM:SS', which may pass 24 hours."""
    p = F.split(F.trim(text), ":")
    return F.get(p, 0).cast("int") * 3600 + F.get(p, 1).cast("int") * 60 + F.coalesce(F.get(p, 2).cast("int"), F.lit(0))


# --- command-line dates ------------------------------------------------------------------------------------------------


def parse_time(text: str, now: datetime | None = None) -> datetime:
    """'now', 'today', an ISO time or yyyy-MM-dd_HH:mm:ss, with '/Area/City' behind it for a zone; UTC without."""
    now = now or datetime.now(timezone.utc)
    zone = timezone.utc
    if "/" in text:
        text, name = text.split("/", 1)
        zone = ZoneInfo(name)
    if text == "now":
        return now.replace(microsecond=0)
    if text == "today":
        local = now.astimezone(zone)
        return local.replace(hour=0, minute=0, second=0, microsecond=0).astimezone(timezone.utc)
    made = datetime.fromisoformat(text.replace("_", "T"))
    return (made if made.tzinfo else made.replace(tzinfo=zone)).astimezone(timezone.utc)


def parse_span(text: str, start: datetime) -> int:
    """Seconds of '1hour', '2days', a number of seconds, or the time until an end date."""
    if m := re.fullmatch(r"(\d+)\s*(second|minute|hour|day|week)s?", text):
        return int(m[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[m[2]]
    if text.isdigit():
        return int(text)
    return int((parse_time(text) - start).total_seconds())


def local_to_utc(local: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(local, zone)


def utc_to_local(utc: Column, zone: Column | str) -> Column:
    return F.from_utc_timestamp(utc, zone)


def timezone_report(zone: str, at: datetime) -> str:
    local = at.astimezone(ZoneInfo(zone))
    return f"{at.isoformat()} is {local.isoformat()} in {zone}"


# --- strings -----------------------------------------------------------------------------------------------------------


def file_name(text: Column) -> Column:
    """Characters that a file name must not have become '_'."""
    return F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]', "_")


MAP_URL = r"^(?:https?://)?(?:www\.)?(?:openstreetmap\.(?:org|com)|osm\.org)/?#map=(\d+(?:\.\d+)?)/(-?\d+(?:\.\d+)?)/(-?\d+(?:\.\d+)?)"


def map_place(url: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a map URL (zoom/lat/lon); null for other texts."""
    ok = url.rlike(MAP_URL)
    return F.when(ok, F.regexp_extract(url, MAP_URL, 3).cast("double")), F.when(ok, F.regexp_extract(url, MAP_URL, 2).cast("double"))


def packed_place(lon: Column, lat: Column) -> Column:
    """One number for a place, to a millionth of a degree."""
    return F.round((lat + 90) * 1e6).cast("bigint") * 1_000_000_000 + F.round((lon + 180) * 1e6).cast("bigint")


# --- combinators -------------------------------------------------------------------------------------------------------

Result = tuple[object, str] | None


@dataclass(frozen=True)
class Parser:
    """A parser from a text to (value, rest), or None."""

    run: Callable[[str], Result]

    def __or__(self, other: Parser) -> Parser:
        return Parser(lambda s: self.run(s) or other.run(s))

    def __add__(self, other: Parser) -> Parser:
        """Both in a row, as a tuple."""
        return self.bind(lambda a: other.map(lambda b: (a, b)))

    def __rshift__(self, other: Parser) -> Parser:
        """Both in a row; the first is discarded."""
        return self.bind(lambda _: other)

    def __lshift__(self, other: Parser) -> Parser:
        """Both in a row; the second is discarded."""
        return self.bind(lambda a: other.map(lambda _: a))

    def map(self, f: Callable) -> Parser:
        return Parser(lambda s: (f(r[0]), r[1]) if (r := self.run(s)) else None)

    def bind(self, f: Callable[[object], Parser]) -> Parser:
        return Parser(lambda s: f(r[0]).run(r[1]) if (r := self.run(s)) else None)

    def default(self, value: object) -> Parser:
        return Parser(lambda s: self.run(s) or (value, s))

    def check(self, f: Callable[[object], bool]) -> Parser:
        return Parser(lambda s: r if (r := self.run(s)) and f(r[0]) else None)

    def many(self) -> Parser:
        def run(s: str) -> Result:
            out = []
            while (r := self.run(s)) and r[1] != s:
                out.append(r[0])
                s = r[1]
            return out, s

        return Parser(run)

    def separated(self, by: Parser) -> Parser:
        return (self + (by >> self).many()).map(lambda x: [x[0], *x[1]])

    def parse(self, text: str) -> object | None:
        """The value if the whole text is read."""
        r = self.run(text)
        return r[0] if r and not r[1].strip() else None


def regex(pattern: str, flags: int = 0) -> Parser:
    rx = re.compile(pattern, flags)
    return Parser(lambda s: (m[0], s[m.end() :]) if (m := rx.match(s)) else None)


def literal(text: str) -> Parser:
    return Parser(lambda s: (text, s[len(text) :]) if s[: len(text)].lower() == text.lower() else None)


space = regex(r"\s*")
integer = regex(r"[+-]?\d+").map(int)
number = regex(r"[+-]?\d+(?:\.\d+)?").map(float)
duration = Parser(lambda s: (v, "") if (v := parse_duration(s)) is not None else None)

#: Names of months and weekdays (fixed values).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")


def _named(names: tuple[str, ...]) -> Parser:
    return regex("|".join(names), re.I).map(lambda x: names.index(x.lower()))


hour_minute = (integer.check(lambda h: 0 <= h <= 26) + (literal(":") >> integer.check(lambda m: 0 <= m < 60))).map(lambda x: ("time", x[0] * 60 + x[1]))
weekday = _named(WEEKDAYS).map(lambda d: ("weekday", d))
month = _named(MONTHS).map(lambda m: ("month", m + 1))
month_day = (month + (space >> integer.check(lambda d: 1 <= d <= 31))).map(lambda x: ("date", (x[0][1], x[1])))
week = (literal("week") >> space >> integer.check(lambda w: 1 <= w <= 53)).map(lambda w: ("week", w))
easter_day = literal("easter").map(lambda _: ("easter", 0))
comment = regex(r'"[^"]*"').map(lambda c: ("comment", c[1:-1]))
#: A weekday within a month, as in "Oct Sa".
month_weekday = (month + (space >> weekday)).map(lambda x: ("chain", x[0], x[1]))
term = hour_minute | week | easter_day | month_day | month_weekday | month | weekday | comment


def ranged(p: Parser) -> Parser:
    return (p + (space >> literal("-") >> space >> p).default(None)).map(lambda x: ("range", x[0], x[1]) if x[1] else x[0])


#: A rule of opening hours: terms and ranges of terms, separated by commas or spaces.
opening_hours_rule = ranged(term).separated(regex(r"\s*,\s*|\s+"))


# --- timed elements ----------------------------------------------------------------------------------------------------


def easter(year: int) -> date:
    """Easter Sunday by Gauss's rule for the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    k = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    rest = (32 + 2 * (b % 4) + 2 * (c // 4) - k - c % 4) % 7
    m = (a + 11 * k + 22 * rest) // 451
    month_, day = divmod(k + rest - 7 * m + 114, 31)
    return date(year, month_, day + 1)


@dataclass(frozen=True)
class Timed:
    """A recurring point in time: next gives the first at or after a time, prev the last before it."""

    kind: str
    value: object = 0
    offset: int = 0

    def _candidates(self, around: datetime) -> list[datetime]:
        day = around.replace(hour=0, minute=0, second=0, microsecond=0)
        at = lambda y, m=1, d=1: datetime(y, m, d, tzinfo=around.tzinfo)
        years = range(around.year - 9, around.year + 10)
        if self.kind == "minute":
            hour = around.replace(minute=0, second=0, microsecond=0)
            return [hour + timedelta(hours=h, minutes=self.value) for h in (-2, -1, 0, 1, 2)]
        if self.kind == "hour":
            return [day + timedelta(days=d, hours=self.value) for d in (-2, -1, 0, 1, 2)]
        if self.kind == "time":
            return [day + timedelta(days=d, minutes=self.value) for d in (-2, -1, 0, 1, 2)]
        if self.kind == "weekday":
            return [day + timedelta(days=d) for d in range(-8, 9) if (day + timedelta(days=d)).weekday() == self.value]
        if self.kind == "day_of_month":
            months = [(around.year + (around.month - 1 + k) // 12, (around.month - 1 + k) % 12 + 1) for k in range(-4, 5)]
            return [at(y, m, self.value) for y, m in months if self.value <= _days_in(y, m)]
        if self.kind == "month":
            return [at(y, self.value) for y in years]
        if self.kind == "date":
            return [at(y, *self.value) for y in years if self.value[1] <= _days_in(y, self.value[0])]
        if self.kind == "week":
            return [datetime.combine(date.fromisocalendar(y, self.value, 1), datetime.min.time(), around.tzinfo) for y in years if self.value <= date(y, 12, 28).isocalendar()[1]]
        if self.kind == "easter":
            return [datetime.combine(easter(y), datetime.min.time(), around.tzinfo) for y in years]
        raise ValueError(self.kind)

    def next(self, t: datetime) -> datetime:
        shift = timedelta(seconds=self.offset)
        return min(x + shift for x in self._candidates(t - shift) if x + shift >= t)

    def prev(self, t: datetime) -> datetime:
        shift = timedelta(seconds=self.offset)
        return max(x + shift for x in self._candidates(t - shift) if x + shift < t)

    def shifted(self, seconds: int) -> Timed:
        return Timed(self.kind, self.value, self.offset + seconds)

    def skip(self, t: datetime, n: int) -> datetime:
        """The n-th after next."""
        for _ in range(n):
            t = self.next(t) + timedelta(seconds=1)
        return self.next(t)

    def then(self, other: Timed, t: datetime) -> datetime:
        """The next of other after the next of this."""
        return other.next(self.next(t))


def _days_in(year: int, month_: int) -> int:
    return (date(year + month_ // 12, month_ % 12 + 1, 1) - timedelta(days=1)).day


def clock_of_periods(periods: list[int]) -> int:
    """The tick that all periods are multiples of."""
    return math.gcd(*periods) if periods else 60
