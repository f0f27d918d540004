"""Calendar expressions.

All of them work on dates inside, never on zoned timestamps, so results do not depend on
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The interval names a chart accepts, with the unit and label format of each.
INTERVALS = {
    "Years": ("year", "yyyy"),
    "Quarters": ("quarter", "MMM-yyyy"),
    "Months": ("month", "MMM-yyyy"),
}

# Fixed value: how a date with a time is written.
DATETIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"


def _unit(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {list(INTERVALS)}, not {interval!r}")
    return INTERVALS[interval][0]


def parse_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text to date, NULL when it is not one."""
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_datetime(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to timestamp, NULL for anything else (also a bare date)."""
    return F.when(text.rlike(DATETIME), text.try_cast("timestamp_ntz"))


def age_years(birthdate: Column, as_of: Column) -> Column:
    """Completed years. A 29 February birthday is reached on 1 March of a common year."""
    before_birthday = (F.month(as_of) < F.month(birthdate)) | (
        (F.month(as_of) == F.month(birthdate)) & (F.day(as_of) < F.day(birthdate))
    )
    return F.year(as_of) - F.year(birthdate) - before_birthday.cast("int")


def bucket(ts: Column, interval: str) -> Column:
    """Start of the year, quarter or month that ``ts`` falls in."""
    return F.trunc(ts.cast("date"), _unit(interval)).cast("timestamp_ntz")


def bucket_label(start: Column, interval: str) -> Column:
    _unit(interval)
    return F.date_format(start, INTERVALS[interval][1])


def ceil_year(ts: Column) -> Column:
    """Start of the next year; an exact start of year stays as it is."""
    start = F.trunc(ts.cast("date"), "year")
    following = F.add_months(start, 12)
    exact = start.cast("timestamp_ntz") == ts.cast("timestamp_ntz")
    return F.when(exact, start).otherwise(following).cast("timestamp_ntz")


def quarter_grid(first: Column, last: Column) -> Column:
    """Array of quarter starts from ``first`` to ``last``."""
    days = F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 3 months"))
    return F.transform(days, lambda day: day.cast("timestamp_ntz"))


def add_days(day: Column, days: int) -> Column:
    return F.date_add(day, days)


def range_start_default(as_of: Column) -> Column:
    """Start of the default search range: 365 days back."""
    return F.date_sub(as_of, 365)
