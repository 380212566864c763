"""Readers and writers."""

from lifeledger.sources.extracts import (
    align,
    load_markov_params,
    load_state_costs,
    load_table,
    normalize_columns,
    read_extract,
    read_lookup,
    save_table,
    write_csv,
)

__all__ = [
    "align", "load_markov_params", "load_state_costs", "load_table", "normalize_columns", "read_extract",
    "read_lookup", "save_table", "write_csv",
]
