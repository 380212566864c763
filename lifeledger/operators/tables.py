"""Baseline characteristics by arm."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.functions import normal_sf
from lifeledger.functions.special import t_two_sided
from lifeledger.operators.relational import stack


def _sums(df: DataFrame, arm: str, continuous: Sequence[str], categorical: Mapping[str, Sequence]) -> DataFrame:
    """One pass over the data: n, mean, variance and level counts of every variable by arm, one row in all."""
    parts = []
    for a in (0, 1):
        here = F.col(arm) == a
        parts.append(F.count_if(here).alias(f"n_{a}"))
        for c in continuous:
            value = F.when(here, F.col(c).cast("double"))
            parts += [F.avg(value).alias(f"{c}|mean_{a}"), F.stddev_samp(value).alias(f"{c}|sd_{a}")]
        for c, levels in categorical.items():
            parts += [
                F.count_if(here & F.col(c).eqNullSafe(v)).alias(f"{c}|{i}|count_{a}") for i, v in enumerate(levels)
            ]
    return df.agg(*parts)


def baseline_table(
    df: DataFrame, arm: str, continuous: Sequence[str], categorical: Mapping[str, Sequence]
) -> DataFrame:
    """One row per (variable, level): size, mean, sd, count and share by arm, and the standardised difference.

    The difference is |m1-m2| over the pooled standard deviation; for a level it is taken on its share.
    """
    sums = _sums(df, arm, continuous, categorical)
    null = F.lit(None).cast("double")
    rows = []
    for c in continuous:
        m0, m1, s0, s1 = (F.col(f"{c}|{k}") for k in ("mean_0", "mean_1", "sd_0", "sd_1"))
        smd = F.try_divide(F.abs(m0 - m1), F.sqrt((s0 * s0 + s1 * s1) / 2))
        rows.append(_entry(c, None, m0, m1, s0, s1, null, null, null, null, smd))
    for c, levels in categorical.items():
        for i, v in enumerate(levels):
            k0, k1 = F.col(f"{c}|{i}|count_0"), F.col(f"{c}|{i}|count_1")
            p0, p1 = F.try_divide(k0, F.col("n_0")), F.try_divide(k1, F.col("n_1"))
            smd = F.try_divide(F.abs(p0 - p1), F.sqrt((p0 * (1 - p0) + p1 * (1 - p1)) / 2))
            rows.append(_entry(c, str(v), null, null, null, null, k0, k1, p0, p1, smd))
    return sums.select("n_0", "n_1", F.inline(F.array(*rows)))


def _entry(variable, level, m0, m1, s0, s1, k0, k1, p0, p1, smd) -> Column:
    fields = {
        "mean_0": m0, "mean_1": m1, "sd_0": s0, "sd_1": s1, "count_0": k0, "count_1": k1,
        "share_0": p0, "share_1": p1, "smd": smd,
    }
    return F.struct(
        F.lit(variable).alias("variable"), F.lit(level).cast("string").alias("level"),
        *[v.cast("double").alias(k) for k, v in fields.items()],
    )


def _chi_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-squared by its finite recurrence, which starts at 1 or 2 degrees of freedom."""
    half = x / 2
    if df % 2:
        tail = F.lit(2.0) * normal_sf(F.sqrt(x))
        term, k = F.sqrt(F.lit(2.0) * x / F.lit(np.pi)) * F.exp(-half), 1
        while k < df:
            tail, term, k = tail + term, term * x / F.lit(float(k + 2)), k + 2
        return tail
    tail, term, k = F.exp(-half), F.exp(-half) * half, 2
    while k < df:
        tail, term, k = tail + term, term * half / F.lit(k / 2 + 1), k + 2
    return tail


def baseline_tests(
    df: DataFrame, arm: str, continuous: Sequence[str], categorical: Mapping[str, Sequence]
) -> DataFrame:
    """(variable, statistic, df, p): equal-variance t test or chi-squared, corrected when 2 x 2."""
    sums = _sums(df, arm, continuous, categorical)
    n0, n1 = F.col("n_0").cast("double"), F.col("n_1").cast("double")
    # All variables come out of the one row of sums, so the table is read once.
    out = []

    def test(variable: str, kind: str, statistic: Column, freedom: Column, p: Column) -> Column:
        return F.struct(
            F.lit(variable).alias("variable"), F.lit(kind).alias("kind"), statistic.alias("statistic"),
            freedom.alias("df"), p.cast("double").alias("chi_p"),
        )

    for c in continuous:
        m0, m1, s0, s1 = (F.col(f"{c}|{k}") for k in ("mean_0", "mean_1", "sd_0", "sd_1"))
        freedom = n0 + n1 - 2
        pooled = ((n0 - 1) * s0 * s0 + (n1 - 1) * s1 * s1) / freedom
        t = (m1 - m0) / F.sqrt(pooled * (1 / n0 + 1 / n1))
        out.append(test(c, "t", t, freedom, F.lit(None)))
    for c, levels in categorical.items():
        counts = [(F.col(f"{c}|{i}|count_0"), F.col(f"{c}|{i}|count_1")) for i in range(len(levels))]
        # Yates' correction for 2 x 2: each difference shrinks by 1/2, but not below zero.
        shrink = 0.5 if len(levels) == 2 else 0.0
        parts = []
        for k0, k1 in counts:
            for k, n in ((k0, n0), (k1, n1)):
                expected = (k0 + k1) * n / (n0 + n1)
                off = F.greatest(F.abs(k - expected) - F.lit(shrink), F.lit(0.0))
                parts.append(F.coalesce(F.try_divide(off * off, expected), F.lit(0.0)))
        statistic = reduce(lambda a, b: a + b, parts)
        freedom = len(levels) - 1
        out.append(test(c, "chi2", statistic, F.lit(float(freedom)), _chi_sf(statistic, freedom)))
    rows = sums.select(F.inline(F.array(*out)))
    is_t = F.col("kind") == "t"
    t_p = t_two_sided(F.col("statistic"), F.col("df"))
    return rows.select("variable", "statistic", "df", F.when(is_t, t_p).otherwise(F.col("chi_p")).alias("p"))
