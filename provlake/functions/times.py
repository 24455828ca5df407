"""Times and schedules. Epoch milliseconds in, session time zone UTC."""

from __future__ import annotations

from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def utc(ms: Column) -> Column:
    """DAT01."""
    return F.timestamp_millis(ms.cast("long"))


def search_tokens(ms: Column) -> list[Column]:
    """DAT02: the forms in which browsing finds a time."""
    t = utc(ms)
    return [F.date_format(t, f) for f in ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "yyyy", "M", "d")]


def display(ms: Column) -> Column:
    """DAT03."""
    return F.concat(F.date_format(utc(ms), "EEE dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def to_utc_ms(local: Column, zone: Column) -> Column:
    """DAT07: an ISO local time in a zone, as epoch milliseconds."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(local), zone))


@cache
def _zone_names() -> tuple[str, ...]:
    """The IANA names that Spark can read, some 600: the JVM's, and three that it has as short names."""
    return tuple(sorted({*SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds(), "EST", "HST", "MST"}))


def known_zone(zone: Column) -> Column:
    """DAT06: the zone if it is an IANA name, with a slash or without, else UTC."""
    return F.when(zone.isin(*_zone_names()), zone).otherwise(F.lit("UTC"))


def minutes_of(hhmm: Column) -> Column:
    """DAT06: HH:MM as minutes of the day, null if it has another form."""
    ok = hhmm.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    return F.when(ok, F.split(hhmm, ":")[0].cast("int") * 60 + F.split(hhmm, ":")[1].cast("int"))


def _interval_ms(unit: Column, value: Column) -> Column:
    return F.when(unit == "minutes", value * 60_000).when(unit == "hours", value * 3_600_000).cast("long")


def _calendar_run(ms: Column, zone: Column, minutes: Column, days_ahead: Column, again: Column, strict: bool) -> Column:
    """The local day `days_ahead` from ms at `minutes`; `again` days later if that is today and not after ms."""
    local = F.from_utc_timestamp(utc(ms), zone)
    at = lambda days: F.timestamp_seconds(F.unix_seconds(F.date_add(F.to_date(local), days).cast("timestamp")) + minutes * 60)
    passed = (at(F.lit(0)) <= local) if strict else (at(F.lit(0)) < local)
    days = F.when((days_ahead == 0) & passed, again).otherwise(days_ahead)
    return F.unix_millis(F.to_utc_timestamp(at(days), zone))


def next_run(ms: Column, zone: Column, mode: Column, unit: Column, value: Column, daily_time: Column, weekly_day: Column, weekly_time: Column, strict: bool = True) -> Column:
    """DAT04: the run after ms by the schedule's rule, null where the rule is incomplete.

    Days and times are those of the schedule's zone, so a daily run keeps its local hour when the clocks change.
    """
    zone = known_zone(zone)
    local = F.from_utc_timestamp(utc(ms), zone)
    target = F.array_position(F.array(*map(F.lit, _DAYS)), F.lower(weekly_day)) - 1
    ahead = F.when(target >= 0, F.pmod(target - F.weekday(local), F.lit(7))).cast("int")
    return (
        F.when(mode == "interval", ms + _interval_ms(unit, value))
        .when(mode == "daily", _calendar_run(ms, zone, minutes_of(daily_time), F.lit(0), F.lit(1), strict))
        .when(mode == "weekly", _calendar_run(ms, zone, minutes_of(weekly_time), ahead, F.lit(7), strict))
    )


def first_run(start: Column, now: Column, zone: Column, mode: Column, unit: Column, value: Column, daily_time: Column, weekly_day: Column, weekly_time: Column) -> Column:
    """DAT05: the first run of a new schedule: of an interval, the start or the next slot after now; else the next calendar run."""
    step = _interval_ms(unit, value)
    slot = F.when(start > now, start).otherwise(start + (F.floor((now - start) / step) + 1) * step)
    later = next_run(F.greatest(start, now), zone, mode, unit, value, daily_time, weekly_day, weekly_time, strict=False)
    return F.when(mode == "interval", slot).otherwise(later)
