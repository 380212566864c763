"""Registry of queries with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from lifeledger.plans.roles import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(sql: str, own: Mapping[str, str] | None = None) -> str:
    """Put the definitions a statement uses, directly or not, in front of it; ``own`` ones replace shared ones."""
    ctes = {**CTES, **(own or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b[rmck]_\w+", text):
            if name in ctes and name not in needed:
                needed.add(name)
                visit(ctes[name])

    visit(sql)
    if not needed:
        return sql
    # Definitions stand in CTES in order of dependency.
    parts = ",\n".join(f"{n} AS ({ctes[n]})" for n in ctes if n in needed)
    begun = re.match(r"\s*WITH\s+", sql)
    return f"WITH RECURSIVE {parts},\n{sql[begun.end():]}" if begun else f"WITH RECURSIVE {parts}\n{sql}"


def query(sql: str | None = None, name: str | None = None, ctes: Mapping[str, str] | None = None):
    """Register ``f(tables)`` under its own name, with its oracle statement if there is one.

    ``ctes`` holds definitions that this statement has otherwise than the shared ``CTES``.
    """

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = with_ctes(sql, ctes)
        return f

    return register
