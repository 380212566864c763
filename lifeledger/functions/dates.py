"""Date arithmetic with the study's day and age conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inclusive_days(ref: Column, end: Column) -> Column:
    """Days from ``ref`` to ``end`` counting both ends: the same day is 1, reversed is <= 0."""
    return F.datediff(end, ref) + F.lit(1)


def completed_years(birth: Column, ref: Column) -> Column:
    """Whole years lived at ``ref``; a 29 February birthday completes on 1 March."""
    month_gap = F.month(ref) - F.month(birth)
    day_gap = F.dayofmonth(ref) - F.dayofmonth(birth)
    not_yet = (month_gap < 0) | ((month_gap == 0) & (day_gap < 0))
    return F.year(ref) - F.year(birth) - not_yet.cast("int")


def parse_date(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that is no date becomes null instead of an error."""
    return F.try_to_date(text, fmt)


def add_days(date: Column, days: int | Column) -> Column:
    return F.date_add(date, days)
