"""Date and time functions, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import col

now = F.current_timestamp


# The names of the parts and their abbreviations.
PARTS = {
    "year": ("yy", "yyyy"), "quarter": ("qq", "q"), "month": ("mm", "m"), "dayofyear": ("dy", "y"), "day": ("dd", "d"),
    "week": ("wk", "ww"), "weekday": ("dw",), "hour": ("hh",), "minute": ("mi", "n"), "second": ("ss", "s"),
    "millisecond": ("ms",), "microsecond": ("mcs",), "nanosecond": ("ns",),
}


def part_name(part: str) -> str:
    """The full name of a part, in any case or abbreviated; an error if there is none."""
    name = part.strip().lower()
    for full, short in PARTS.items():
        if name == full or name in short:
            return full
    raise ValueError(f"unknown part of a date: {part!r}")


def dateadd(part: str, n, ts) -> Column:
    """Months clamp to the month's end; nanoseconds are rounded down to microseconds."""
    part = part_name(part)
    if part == "nanosecond":
        n = col(n).cast("bigint")
        return F.timestamp_add("MICROSECOND", F.call_function("div", n - F.pmod(n, F.lit(1000)), F.lit(1000)), col(ts))
    return F.timestamp_add("DAY" if part in ("dayofyear", "weekday") else part.upper(), col(n), col(ts))


def _days(ts) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")


def datediff(part: str, a, b) -> Column:
    """How many boundaries of the part lie between; weeks begin on Sunday."""
    a, b = col(a), col(b)
    part = part_name(part)
    if part == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    if part in ("quarter", "month"):
        months = lambda t: F.year(t) * 12 + F.month(t) - 1
        q = lambda t: F.year(t) * 4 + F.quarter(t)
        return ((q(b) - q(a)) if part == "quarter" else (months(b) - months(a))).cast("bigint")
    if part in ("day", "dayofyear", "weekday"):
        return _days(b) - _days(a)
    if part == "week":
        week = lambda t: F.floor((_days(t) + 4) / 7)  # noqa: E731  1970-01-01 was a Thursday
        return (week(b) - week(a)).cast("bigint")
    if part in ("microsecond", "nanosecond"):
        micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
        return micros if part == "microsecond" else micros * 1000
    unit = {"hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}[part]
    ticks = lambda t: F.floor(F.unix_millis(t.cast("timestamp")) / unit)
    return (ticks(b) - ticks(a)).cast("bigint")


def datepart(part: str, ts) -> Column:
    ts, part = col(ts), part_name(part)
    plain = {"year": F.year, "quarter": F.quarter, "month": F.month, "dayofyear": F.dayofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.dayofweek}
    if part in plain:
        return plain[part](ts).cast("bigint")
    if part == "week":  # week 1 holds January 1st; weeks begin on Sunday
        return (F.floor((F.dayofyear(ts) - 1 + F.dayofweek(F.trunc(ts, "year")) - 1) / 7) + 1).cast("bigint")
    if part == "millisecond":
        return F.pmod(F.unix_millis(ts.cast("timestamp")), F.lit(1000))
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return micros if part == "microsecond" else micros * 1000


def datename(part: str, ts) -> Column:
    if part_name(part) == "month":
        return F.date_format(col(ts), "MMMM")
    if part_name(part) == "weekday":
        return F.date_format(col(ts), "EEEE")
    return datepart(part, ts).cast("string")


def eomonth(ts, months=0) -> Column:
    return F.last_day(F.add_months(F.to_date(col(ts)), col(months))).cast("timestamp_ntz")


def from_parts(year, month, day, hour=0, minute=0, second=0) -> Column:
    """Null if any part is; an error if they make no date."""
    return F.make_timestamp_ntz(*[col(x) for x in (year, month, day, hour, minute)], col(second).cast("decimal(8,6)"))


def smalldatetime(year, month, day, hour, minute, second) -> Column:
    """To the minute; 30 seconds and more round up."""
    base = from_parts(year, month, day, hour, minute)
    return F.timestamp_add("MINUTE", F.when(col(second) >= 30, 1).otherwise(0), base)


def shift_ms(ts, ms) -> Column:
    """A timestamp plus an integer moves it by milliseconds."""
    return F.timestamp_millis(F.unix_millis(col(ts).cast("timestamp")) + col(ms)).cast("timestamp_ntz")


def ms_between(a, b) -> Column:
    return F.unix_millis(col(a).cast("timestamp")) - F.unix_millis(col(b).cast("timestamp"))


def to_date(ts) -> Column:
    """A date is a timestamp at midnight."""
    return F.date_trunc("day", col(ts)).cast("timestamp_ntz")
