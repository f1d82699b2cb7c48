"""Strict dates, clock times and weekday arithmetic, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT_DATE = r"^(\d{1,2})[./](\d{1,2})[./](\d{2}|\d{4})\z"


def parse_date_strict(text: Column) -> Column:
    """D.M.YYYY, D/M/YYYY or a two-digit year; anything else, and days that do not exist, give null."""
    year_text = F.regexp_extract(text, _STRICT_DATE, 3)
    year = F.nullif(year_text, F.lit("")).try_cast("int")
    full_year = (
        F.when((F.length(year_text) == 2) & (year >= 70), year + 1900)
        .when(F.length(year_text) == 2, year + 2000)
        .when(year >= 100, year)
    )
    month = F.nullif(F.regexp_extract(text, _STRICT_DATE, 2), F.lit("")).try_cast("int")
    day = F.nullif(F.regexp_extract(text, _STRICT_DATE, 1), F.lit("")).try_cast("int")
    zero = F.lit(0)
    return F.try_make_timestamp(full_year, month, day, zero, zero, F.lit(0.0))


def parse_instant(text: Column) -> Column:
    """ISO date or date-time text to an instant; unparseable text is null."""
    return F.nullif(text, F.lit("")).try_cast("timestamp")


def hhmm_to_min(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.get(parts, 0).try_cast("int") * 60 + F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(0))


# Weekday names and their index, Sunday first.
WEEKDAY_INDEX = {"sun": 0, "mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6}


def next_weekday_at(weekday: Column, hhmm: Column, now: Column) -> Column:
    """Next instant that falls on ``weekday`` at ``hhmm``: today when that is still ahead, else within 7 days."""
    table = F.create_map(*[F.lit(v) for pair in WEEKDAY_INDEX.items() for v in pair])
    wanted = F.coalesce(F.try_element_at(table, weekday), F.lit(1))
    ahead = F.pmod(wanted - (F.dayofweek(now) - 1), F.lit(7))
    at = lambda days: F.timestamp_add(
        "MINUTE", hhmm_to_min(hhmm), F.date_add(F.to_date(now), days).cast("timestamp")
    )
    today = at(F.lit(0))
    return F.when((ahead == 0) & (today <= now), at(F.lit(7))).otherwise(at(ahead))


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def dmy(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy")
