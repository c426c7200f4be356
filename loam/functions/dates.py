"""Dates of items and age limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may hold an item's date, in this order; greatest age in months by category.
DATE_KEYS = ("time", "date", "idate", "published_on", "created_at", "updated_at", "end_time")
MAX_AGE = {"tender": 6, "notices": 1, "notice": 1, "notification": 1, "notifications": 1, "recruitments": 1}


def months_ago(now: Column, months: Column) -> Column:
    """Midnight the given months ago; a day that the month lacks runs on into the next month."""
    day = F.to_date(now)
    return F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)


def epoch(n: Column) -> Column:
    """Time of a number: over 1e12 milliseconds, else seconds."""
    ms = F.when(n > 1e12, n).otherwise(n * 1000)
    return F.timestamp_millis(ms.cast("bigint"))


def item_date(text: Column) -> Column:
    """Time of a date text: ten or more digits are a number, else ISO text; null if neither."""
    return F.when(text.rlike(r"^\d{10,}$"), epoch(text.cast("double"))).otherwise(F.try_to_timestamp(text))


def max_age(category: Column) -> Column:
    """Months an item of the category (in any letter case) may be old; null is no limit."""
    out = None
    for name, n in MAX_AGE.items():
        out = F.when(F.lower(category) == name, n) if out is None else out.when(F.lower(category) == name, n)
    return out


def is_recent(date: Column, category: Column, now: Column) -> Column:
    """Whether an item is young enough for its category; undated ones and other categories are."""
    return F.coalesce(date >= months_ago(now, max_age(category)), F.lit(True))
