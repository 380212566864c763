"""Column expressions. Everything here stays inside whole-stage code generation."""

from lifeledger.functions.dates import add_days, completed_years, inclusive_days, parse_date
from lifeledger.functions.special import (
    digamma,
    lgamma,
    log_normal_sf,
    normal_hazard,
    normal_quantile,
    normal_sf,
    trigamma,
)
from lifeledger.functions.text import (
    any_column_matches,
    contains_pattern,
    excludes_pattern,
    normalize_name,
    one_pattern,
)
from lifeledger.functions.values import (
    age_band,
    band,
    clip_zero,
    earlier,
    if_else,
    later,
    null_if,
    parse_number,
    per_person_year,
    replace_null,
)

__all__ = [
    "add_days", "age_band", "any_column_matches", "band", "clip_zero", "completed_years",
    "contains_pattern", "digamma", "earlier", "excludes_pattern", "if_else", "inclusive_days",
    "later", "lgamma", "log_normal_sf", "normal_hazard", "normal_quantile", "normal_sf",
    "normalize_name", "null_if", "one_pattern", "parse_date", "parse_number", "per_person_year",
    "replace_null", "trigamma",
]
