"""Pattern tests with explicit null behaviour, and header clean-up."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_pattern(text: Column, pattern: str) -> Column:
    """True where the pattern occurs anywhere in the text; null text counts as no match."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def excludes_pattern(text: Column, pattern: str) -> Column:
    """Complement of :func:`contains_pattern`, so rows with null text are kept."""
    return ~contains_pattern(text, pattern)


def one_pattern(patterns: Iterable[str]) -> str:
    """One alternation out of a short list of patterns."""
    return "|".join(patterns)


def any_column_matches(columns: Sequence[Column], pattern: str, strict: bool = False) -> Column:
    """True if the pattern occurs in any of the columns.

    The default searches the columns joined by blanks, nulls spelled ``NA``, so a wildcard may
    reach across two neighbouring columns. ``strict`` tests each column alone.
    """
    if strict:
        return F.exists(F.array(*columns), lambda c: contains_pattern(c, pattern))
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("NA")) for c in columns])
    return joined.rlike(pattern)


def normalize_name(name: str) -> str:
    """Header text to a column name: lower case, one underscore for each run of other characters."""
    text = re.sub(r"\n|  ", "", name)
    return re.sub(r"[^0-9a-z]+", "_", text.lower())
