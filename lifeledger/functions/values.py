"""Null, flag, banding and rate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25

# Age bands, as (highest age in the band, label).
AGE_BANDS = [(24, "10-24"), (40, "25-40"), (65, "41-65"), (None, "65+")]


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice in which a null condition gives null (a plain ``otherwise`` would give ``no``)."""
    return F.when(condition, _col(yes)).when(~condition, _col(no))


def replace_null(value: Column, default) -> Column:
    return F.coalesce(value, _col(default))


def null_if(value: Column, sentinel) -> Column:
    return F.nullif(value, _col(sentinel))


def later(*dates: Column) -> Column:
    """Latest of several dates. Nulls are skipped, so fill them first when null must win."""
    return F.greatest(*dates)


def earlier(*dates: Column) -> Column:
    return F.least(*dates)


def clip_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def parse_number(text: Column) -> Column:
    """Text to double; text that is no number becomes null."""
    return text.try_cast("double")


def per_person_year(amount: Column, days: Column) -> Column:
    """Amount per year of follow-up; zero follow-up gives null, not an error."""
    return F.try_divide(amount.cast("double"), days / F.lit(DAYS_PER_YEAR))


def band(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first band whose upper edge is not exceeded; an edge of None is open."""
    out = None
    for upper, label in bands:
        test = value.isNotNull() if upper is None else value <= upper
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def age_band(age: Column) -> Column:
    return band(age, AGE_BANDS)
