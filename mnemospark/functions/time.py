"""Dates in texts, relative times and recency."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = {"today": 0, "yesterday": 1, "week": 7, "last-week": 7, "month": 30, "year": 365, "d": 1, "w": 7, "m": 30, "y": 365}
NAMED = ("today", "yesterday", "week", "last-week", "month", "year")
HALF_LIFE_DAYS = 60


def extract_date(text: Column) -> Column:
    """The first yyyy-mm-dd, if its month and day can be; else the first ``Month d, yyyy``; else null.  No calendar check."""
    edge, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    iso = F.regexp_extract(text, rf"{edge}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}){end}", 1)
    in_range = F.substring(iso, 6, 2).between("01", "12") & F.substring(iso, 9, 2).between("01", "31")
    named = rf"{edge}([A-Za-z]{{3,9}})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}){end}"
    name, day, year = (F.regexp_extract(text, named, i) for i in (1, 2, 3))
    table = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    month = F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.lower(name))
    fine = month.isNotNull() & F.lpad(day, 2, "0").between("01", "31")
    written = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when((iso != "") & in_range, iso).when(fine, written)


def date_to_time(date: Column) -> Column:
    """UTC midnight of yyyy-mm-dd; a day that the month doesn't have rolls over."""
    part = lambda at, n: F.substring(date, at, n).cast("int")
    return F.date_add(F.make_date(part(1, 4), part(6, 2), F.lit(1)), part(9, 2) - 1).cast("timestamp")


def parse_when(value: str | None, now: dt.datetime) -> dt.datetime | None:
    """A relative or absolute time; relative ones count back from ``now``, not from midnight.  Case counts, and blanks aren't trimmed."""
    if not value:
        return None
    if value in NAMED:
        return now - dt.timedelta(days=DAYS[value])
    if m := re.fullmatch(r"([0-9]+)\s*([dwmy])", value):
        return now - dt.timedelta(days=int(m[1]) * DAYS[m[2]])
    when = dt.datetime.fromisoformat(value)
    return when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)


def parse_when_column(value: Column, now: Column) -> Column:
    """The same for a column; null where the value is empty or can't be read."""
    number = F.regexp_extract(value, r"^([0-9]+)\s*[dwmy]$", 1)
    unit = F.regexp_extract(value, r"^[0-9]+\s*([dwmy])$", 1)
    days = F.create_map(*[F.lit(x) for p in DAYS.items() for x in p])
    back = F.when(value.isin(*NAMED), F.try_element_at(days, value)).when(unit != "", number.cast("int") * F.try_element_at(days, unit))
    return F.when(back.isNotNull(), F.timestamp_add("DAY", -back, now)).otherwise(F.try_to_timestamp(value))


def recency(when: Column, now: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """0.5 ^ (age / half-life); 1 for the future, 0 for an unknown time."""
    age = (F.unix_millis(now) - F.unix_millis(when)) / F.lit(86_400_000.0)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / half_life_days), F.lit(0.0))
