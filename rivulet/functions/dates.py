"""Dates and times: names of parts, intervals, and times relative to now."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions._args import col, value

day_of_month = F.dayofmonth
day_of_week = F.dayofweek
day_of_year = F.dayofyear
hour_of_day = F.hour
minute_of_hour = F.minute
month_of_year = F.month
second_of_minute = F.second
week = F.weekofyear
week_of_year = F.weekofyear
sysdate = F.now
adddate = F.date_add
subdate = F.date_sub

_INTERVALS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond")


def interval(n: int | float | Column, unit: str) -> Column:
    unit = unit.lower()
    if unit not in _INTERVALS:
        raise ValueError(f"unknown unit {unit!r}")
    n = value(n)
    if unit == "quarter":
        return F.make_interval(months=(n * 3).cast("int"))
    if unit in ("millisecond", "microsecond"):
        return F.make_interval(secs=(n / F.lit(1000 if unit == "millisecond" else 1_000_000)).cast("decimal(18,6)"))
    if unit == "second":
        return F.make_interval(secs=n.cast("decimal(18,6)"))
    names = {"minute": "mins"}
    return F.make_interval(**{names.get(unit, unit + "s"): n.cast("int")})


def _shift(x: Column | str, n: int, unit: str, sign: int) -> Column:
    unit = unit.lower()
    day = col(x).cast("date")
    if unit in ("year", "quarter", "month"):
        return F.add_months(day, sign * n * {"year": 12, "quarter": 3, "month": 1}[unit])
    if unit in ("week", "day"):
        return F.date_add(day, sign * n * (7 if unit == "week" else 1))
    return F.timestamp_add(unit.upper(), F.lit(sign * n), day.cast("timestamp"))


def date_add(x: Column | str, n: int, unit: str) -> Column:
    """A date and an interval: a date for days and longer units, a timestamp for shorter ones."""
    return _shift(x, n, unit, 1)


def date_sub(x: Column | str, n: int, unit: str) -> Column:
    return _shift(x, n, unit, -1)


def timestampadd(unit: str, n: int | Column, x: Column | str) -> Column:
    return F.timestamp_add(unit.upper(), value(n), col(x))


def timestampdiff(unit: str, a: Column | str, b: Column | str) -> Column:
    """Whole units from ``a`` to ``b``."""
    return F.timestamp_diff(unit.upper(), col(a), col(b))


def utc_timestamp() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def monthname(x: Column | str) -> Column:
    """January to December."""
    return F.date_format(col(x), "MMMM")


def dayname(x: Column | str) -> Column:
    return F.date_format(col(x), "EEEE")


#: Units of relative times.
RELATIVE_UNITS = {
    "second": ("s", "sec", "secs", "second", "seconds"),
    "minute": ("m", "min", "mins", "minute", "minutes"),
    "hour": ("h", "hr", "hrs", "hour", "hours"),
    "day": ("d", "day", "days"),
    "week": ("w", "wk", "wks", "week", "weeks"),
    "month": ("mon", "month", "months"),
    "quarter": ("q", "qtr", "qtrs", "quarter", "quarters"),
    "year": ("y", "yr", "yrs", "year", "years"),
}
_UNIT = {name: unit for unit, found in RELATIVE_UNITS.items() for name in found}
_RELATIVE = re.compile(r"(?:([+-])(\d*)([a-z]+))?(?:@([a-z]+\d?))?", re.I)


def relative_timestamp(text: str, now: Column | None = None) -> Column:
    """``now``, or ``[+-][n]unit`` and ``@unit``: a time before or after now, cut to the start of a unit.

    Weeks start on Sunday; ``@w1`` is the last Monday and so on. The text is read on the driver
    and becomes an expression, in which Spark keeps the session's time zone.
    """
    at = F.current_timestamp() if now is None else now
    text = text.strip()
    if text.lower() == "now":
        return at
    m = _RELATIVE.fullmatch(text)
    if not m or not text:
        raise ValueError(f"cannot read relative time {text!r}")
    sign, n, unit, snap = m.groups()
    if unit:
        if unit.lower() not in _UNIT:
            raise ValueError(f"unknown unit {unit!r}")
        count = int(n or 1) * (-1 if sign == "-" else 1)
        at = F.timestamp_add(_UNIT[unit.lower()].upper(), F.lit(count), at)
    if snap:
        snap = snap.lower()
        if weekday := re.fullmatch(r"w([0-7])", snap):
            back = (F.dayofweek(at) - 1 - int(weekday[1]) % 7 + 7) % 7
            return F.date_trunc("day", F.timestamp_add("DAY", -back, at))
        if snap not in _UNIT:
            raise ValueError(f"unknown unit {snap!r}")
        if _UNIT[snap] == "week":
            return F.date_trunc("day", F.timestamp_add("DAY", 1 - F.dayofweek(at), at))
        return F.date_trunc(_UNIT[snap], at)
    return at


def earliest(text: str, x: Column | str, now: Column | None = None) -> Column:
    """Whether a time is at or after a relative one."""
    return relative_timestamp(text, now) <= col(x)


def latest(text: str, x: Column | str, now: Column | None = None) -> Column:
    return relative_timestamp(text, now) >= col(x)


def makedate(year: Column | str | int, day: Column | str | int) -> Column:
    """The so-and-so-many-th day of a year, running on into the next ones; null for days below 1."""
    n = value(day) if not isinstance(day, str) else col(day)
    y = value(year) if not isinstance(year, str) else col(year)
    return F.when(n >= 1, F.date_add(F.make_date(y, F.lit(1), F.lit(1)), (n - 1).cast("int")))
