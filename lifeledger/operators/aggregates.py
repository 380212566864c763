"""Per-key and global aggregation. Everything combines on the map side before it is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeledger.functions import per_person_year


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def nth_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n-th row of each key in the given order, nulls last.

    Spark turns the rank filter into a group limit that runs before the shuffle, so a hot key
    sends at most ``n`` rows per input task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == n).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key, all columns kept; ``order`` should name enough columns to break ties."""
    return nth_per_key(df, keys, order, 1)


def last_per_key(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Latest non-null date of each key."""
    return df.groupBy(*keys).agg(F.max(date).alias(date))


def count_priced(df: DataFrame, key: str, price: float, episodes: str, cost: str) -> DataFrame:
    """Rows per key and their price."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(episodes)).withColumn(cost, F.col(episodes) * F.lit(price))


def sum_priced(df: DataFrame, key: str, tariffs: Mapping[str, float], cost_name: str = "{}_cost") -> DataFrame:
    """Sum of several columns per key, each with its price."""
    sums = df.groupBy(key).agg(*[F.sum(c).alias(c) for c in tariffs])
    return sums.withColumns({cost_name.format(c): F.col(c) * F.lit(p) for c, p in tariffs.items()})


def rate_summary(
    df: DataFrame, by: Sequence[str], amounts: Sequence[str], days: str, decimals: int | None = None
) -> DataFrame:
    """Mean and sample standard deviation of per-person-year rates, over rows with days > 0.

    The mean is taken over each row's own ratio; it is not a ratio of sums.
    """
    def shown(c: Column) -> Column:
        return c if decimals is None else F.round(c, decimals)

    out = [F.count(F.lit(1)).alias("n")]
    for c in amounts:
        rate = per_person_year(F.col(c), F.col(days))
        out += [shown(F.avg(rate)).alias(f"mean_{c}_py"), shown(F.stddev_samp(rate)).alias(f"sd_{c}_py")]
    return df.where(F.col(days) > 0).groupBy(*by).agg(*out)


def totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(f"sum_{c}") for c in columns])


def count_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row (rule, violations) per rule, all counted in a single pass."""
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def key_set(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def one_hot(df: DataFrame, key: str, category: str, levels: Sequence[str]) -> DataFrame:
    """0/1 column per level, 1 if the key has the level in any row."""
    return df.groupBy(key).agg(
        *[F.max((F.col(category).eqNullSafe(level)).cast("int")).alias(level) for level in levels]
    )


def prefix_offsets(counts: DataFrame, keys: Sequence[str], block: str, n: str) -> DataFrame:
    """Rows in earlier blocks of the same key, for a frame with one row per (key, block)."""
    window = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum(n).over(window), F.lit(0)))


def rank_within(
    df: DataFrame, keys: Sequence[str], row_id: str, name: str, blocks: int = 256
) -> DataFrame:
    """Number the rows of each key 1, 2, ... without sorting a whole key in one task.

    Rows are ordered by the MD5 of the id's text, then the id. Its first six hex digits name the
    block: each block is numbered alone and then shifted by the size of the blocks before it.
    """
    blocked = df.withColumn("_digest", F.md5(F.col(row_id).cast("string")))
    place = F.conv(F.substring("_digest", 1, 6), 16, 10).cast("long")
    blocked = blocked.withColumn("_block", F.floor(place * blocks / (1 << 24)).cast("int"))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = prefix_offsets(sizes, keys, "_block", "_n").drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_digest", row_id))
    return (
        blocked.withColumn("_inside", inside)
        .join(offsets, on=[*keys, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_digest", "_block", "_inside", "_offset")
    )
