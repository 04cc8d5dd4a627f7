"""Time expressions. Every "now" is an explicit ``as_of`` argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def at(as_of: dt.datetime) -> Column:
    """Literal zone-free timestamp (``F.lit`` would give a zoned one)."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: dt.date) -> Column:
    return F.lit(value)


def month_start(as_of: dt.datetime) -> dt.date:
    return as_of.date().replace(day=1)


def previous_month_start(as_of: dt.datetime) -> dt.date:
    return (month_start(as_of) - dt.timedelta(days=1)).replace(day=1)


def next_month_start(as_of: dt.datetime) -> dt.date:
    return (month_start(as_of) + dt.timedelta(days=31)).replace(day=1)


def midnight(value: dt.date) -> dt.datetime:
    return dt.datetime.combine(value, dt.time())


def in_days(moment: Column, first: dt.date, last: dt.date, zone: str | None = None) -> Column:
    """Whether ``moment`` falls on a local calendar day in ``[first, last]``.

    Written as a half-open range on the raw column so that it reaches the
    parquet scan; a cast of the column to DATE would not.
    """
    low = at(midnight(first))
    high = at(midnight(last + dt.timedelta(days=1)))
    if zone:
        low = F.to_utc_timestamp(low.cast("timestamp"), zone)
        high = F.to_utc_timestamp(high.cast("timestamp"), zone)
    return (moment >= low) & (moment < high)


def local_date(moment: Column, zone: str | None = None) -> Column:
    return (F.from_utc_timestamp(moment, zone) if zone else moment).cast("date")


def plus_minutes(moment: Column, minutes: Column) -> Column:
    return moment + F.make_dt_interval(mins=minutes)


def plus_hours(moment: Column, hours: Column) -> Column:
    return moment + F.make_dt_interval(hours=hours)


def plus_days(moment: Column, days: Column) -> Column:
    return moment + F.make_dt_interval(days=days)


def slot_time(date: Column, minute: Column) -> Column:
    """Date plus minute of day, the start of an appointment."""
    return plus_minutes(date.cast("timestamp_ntz"), minute.cast("int"))


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from ``start`` to ``end``, rounded down."""
    return F.floor(F.timestamp_diff("MINUTE", start, end) / 60).cast("long")
