"""Projections, filters, joins, set operations and sorts.

Joins carry no broadcast hints: Spark broadcasts a side only when its size estimate is below
``spark.sql.autoBroadcastJoinThreshold``, and otherwise sort-merges with AQE skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.functions import contains_pattern, one_pattern, replace_null


# Projections

def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def derive(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add columns one after the other, so that a later one may use an earlier one."""
    for name, expression in steps:
        df = df.withColumn(name, expression)
    return df


# Filters

def date_window(df: DataFrame, date: str, low, high) -> DataFrame:
    """Keep rows whose date lies in the closed window; the bounds may be dates or columns."""
    return df.where(F.col(date).between(low, high))


def in_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key occurs in ``keys``."""
    return df.join(keys, on=on, how="left_semi")


def any_rule(*rules: Column) -> Column:
    """True if one of the rules holds; a rule that is null does not hold."""
    return reduce(lambda a, b: a | b, [replace_null(r, False) for r in rules])


def pattern_from_table(table: DataFrame, column: str) -> str:
    """One alternation of all patterns in a rule table; for large tables ``regex_join`` is the better way."""
    return one_pattern([r[0] for r in table.select(column).distinct().sort(column).collect()])


def conflicting_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that carry more than one distinct value."""
    # Two levels of plain aggregation: the first spreads a hot key over its values.
    pairs = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.lit(1).alias("one"))
    return pairs.groupBy(key).agg(F.count("one").alias("n_values")).where(F.col("n_values") > 1)


def head_preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a given order."""
    return df.orderBy(*order).limit(n)


# Joins

def inner(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on=on, how="inner")


def left_fill(left: DataFrame, right: DataFrame, on, fills: Mapping[str, object]) -> DataFrame:
    """Left join, then a default for the named columns where nothing matched."""
    joined = left.join(right, on=on, how="left")
    return joined.withColumns({c: replace_null(F.col(c), v) for c, v in fills.items()})


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all column names that both sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two sides share no column name")
    return left.join(right, on=shared, how=how)


def overwrite(left: DataFrame, right: DataFrame, on: str, columns: Sequence[str], how="inner") -> DataFrame:
    """Join in which the right-hand columns replace those of the same name on the left."""
    return left.drop(*columns).join(right.select(on, *columns), on=on, how=how)


def code_map(codes: DataFrame, code: str, table: DataFrame, pattern: str, block: int = 250) -> DataFrame:
    """Rows (code, rule columns) for every distinct code and every rule whose pattern it contains.

    Works on distinct codes, so a hot code costs nothing extra. The rule table is packed into
    arrays of about ``block`` rules; each code meets each array once through an equi join and the
    array is filtered in place, so no pair that fails is ever a row.
    """
    rules = table.select(*table.columns).distinct()
    n_blocks = max(1, -(-rules.count() // block))
    slot = F.pmod(F.xxhash64(*table.columns), F.lit(n_blocks)).cast("int")
    packed = rules.groupBy(slot.alias("rule_block")).agg(F.collect_list(F.struct(*table.columns)).alias("rules"))
    spread = (
        codes.select(code).where(F.col(code).isNotNull()).distinct()
        .withColumn("rule_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    hits = F.filter("rules", lambda r: F.rlike(F.col(code), r[pattern]))
    return (
        spread.join(packed, on="rule_block")
        .select(code, F.inline(hits).alias(*table.columns))
    )


def regex_join(
    events: DataFrame, code: str, table: DataFrame, pattern: str, how: str = "left"
) -> DataFrame:
    """Join events to the rules whose pattern occurs in the code; several hits fan out."""
    return events.join(code_map(events, code, table, pattern), on=code, how=how)


def flag_if_in(df: DataFrame, on: str, sets: Mapping[str, DataFrame]) -> DataFrame:
    """0/1 column per key set. All sets are folded into one frame, so one join serves them all."""
    marked = [
        keys.select(on, *[F.lit(int(name == other)).alias(other) for other in sets])
        for name, keys in sets.items()
    ]
    marks = reduce(DataFrame.unionByName, marked).groupBy(on).agg(*[F.max(n).alias(n) for n in sets])
    return left_fill(df, marks, on, {name: 0 for name in sets})


def join_window(
    events: DataFrame, master: DataFrame, on: str, date: str, low: Column, high: Column,
    closed: bool = True, salts: int = 1,
) -> DataFrame:
    """Events inside each entity's own window [low, high], or [low, high) if not ``closed``.

    ``salts`` spreads the events of one entity over that many join keys. It repeats the master,
    which has one narrow row per entity, and is for events that were not cut to one row per day.
    """
    keys = [on]
    if salts > 1:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in events.columns]), F.lit(salts)).cast("int")
        events = events.withColumn("_salt", spread)
        master = master.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    upper = F.col(date) <= high if closed else F.col(date) < high
    joined = events.join(master, on=keys, how="inner").where((F.col(date) >= low) & upper)
    return joined.drop("_salt")


def cross_param(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every row of a parameter table, which is packed into one value."""
    packed = right.agg(F.collect_list(F.struct(*right.columns)).alias("rows")).scalar()
    return left.withColumn("_rows", packed).select(*left.columns, F.inline("_rows"))


# Set operations and sorts

def stack(frames: Sequence[DataFrame], fill: bool = False) -> DataFrame:
    """Stack by column name; with ``fill`` a missing column becomes null, else it is an error."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def sort_by_levels(df: DataFrame, levels: Mapping[str, Sequence[str]], then: Sequence[str] = ()) -> DataFrame:
    """Order by categories in their given order; a value outside the levels comes last."""
    keys = []
    for column, order in levels.items():
        rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
        keys.append(F.when(rank > 0, rank).asc_nulls_last())
    return df.orderBy(*keys, *then)


def matching_rows(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Keep rows whose code contains one of the patterns."""
    return df.where(contains_pattern(F.col(column), one_pattern(patterns)))
