"""Normal and gamma-family functions as column expressions.

Spark SQL has neither an error function nor log-gamma. Both are short rational or asymptotic
series, so they are written as expressions and need no Python worker.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal tail (Hart 1968, algorithm 5666).
HART_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
# Beyond this the continued fraction of the tail is the more accurate one.
FRACTION_FROM = 4.0
FRACTION_TERMS = 20

# Inverse normal, Acklam's rational approximation (refined below by one Newton step).
ACKLAM_A = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
ACKLAM_B = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
]
ACKLAM_C = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
ACKLAM_LOW = 0.02425

LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)
# Terms of the recurrence that lift an argument to where the asymptotic series are exact.
GAMMA_SHIFT = 10


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def tail_ratio(a: Column) -> Column:
    """Q(a) / phi(a) for a >= 0."""
    rational = _poly(HART_NUMERATOR, a) / _poly(HART_DENOMINATOR, a) * F.lit(math.sqrt(2 * math.pi))
    fraction = a + F.lit(0.65)
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = a + F.lit(float(k)) / fraction
    return F.when(a < FRACTION_FROM, rational).otherwise(F.lit(1.0) / fraction)


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2 - F.lit(LOG_SQRT_2PI))


def normal_sf(z: Column) -> Column:
    """P(Z > z) for a standard normal Z."""
    upper = _density(z) * tail_ratio(F.abs(z))
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def log_normal_sf(z: Column, ratio: Column | None = None) -> Column:
    """ln P(Z > z), accurate far into the upper tail. ``ratio`` = tail_ratio(abs(z)) if at hand."""
    ratio = tail_ratio(F.abs(z)) if ratio is None else ratio
    high = -z * z / 2 - F.lit(LOG_SQRT_2PI) + F.log(ratio)
    return F.when(z >= 0, high).otherwise(F.log1p(-_density(z) * ratio))


def normal_hazard(z: Column, ratio: Column | None = None) -> Column:
    """phi(z) / P(Z > z)."""
    ratio = tail_ratio(F.abs(z)) if ratio is None else ratio
    density = _density(z)
    return F.when(z >= 0, F.lit(1.0) / ratio).otherwise(density / (F.lit(1.0) - density * ratio))


def normal_quantile(p: Column) -> Column:
    """Inverse normal for 0 < p < 1."""
    tail = F.least(p, F.lit(1.0) - p)
    r = F.sqrt(F.lit(-2.0) * F.log(tail))
    outer = _poly(ACKLAM_C, r) / _poly(ACKLAM_D, r)
    q = p - F.lit(0.5)
    inner = q * _poly(ACKLAM_A, q * q) / _poly(ACKLAM_B, q * q)
    start = F.when(tail >= ACKLAM_LOW, inner).otherwise(F.when(p < 0.5, outer).otherwise(-outer))
    # One Newton step on the upper-tail probability.
    return start + (normal_sf(start) - (F.lit(1.0) - p)) / _density(start)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    y = x + F.lit(float(GAMMA_SHIFT))
    series = (
        (y - 0.5) * F.log(y) - y + F.lit(LOG_SQRT_2PI)
        + F.lit(1 / 12) / y - F.lit(1 / 360) / F.pow(y, 3) + F.lit(1 / 1260) / F.pow(y, 5)
        - F.lit(1 / 1680) / F.pow(y, 7)
    )
    lifted = x
    for i in range(1, GAMMA_SHIFT):
        lifted = lifted * (x + F.lit(float(i)))
    return series - F.log(lifted)


def lgamma_rise(x: Column, by: Column) -> Column:
    """ln Gamma(x + by) - ln Gamma(x) for x > 0 and x + by > 0, exact in proportion to itself.

    Two large logarithms that nearly cancel would lose that; here only their difference is ever formed.
    """
    y = x + F.lit(float(GAMMA_SHIFT))
    z = y + by
    series = (y + by - F.lit(0.5)) * F.log1p(by / y) + by * (F.log(y) - F.lit(1.0))
    for k, c in ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680)):
        series = series + F.lit(c) / F.pow(z, k) - F.lit(c) / F.pow(y, k)
    lifted = F.lit(1.0) + by / x
    for i in range(1, GAMMA_SHIFT):
        lifted = lifted * (F.lit(1.0) + by / (x + F.lit(float(i))))
    return series - F.log(lifted)


def digamma(x: Column) -> Column:
    """Derivative of ln Gamma(x) for x > 0."""
    y = x + F.lit(float(GAMMA_SHIFT))
    series = (
        F.log(y) - F.lit(0.5) / y - F.lit(1 / 12) / F.pow(y, 2)
        + F.lit(1 / 120) / F.pow(y, 4) - F.lit(1 / 252) / F.pow(y, 6)
        + F.lit(1 / 240) / F.pow(y, 8)
    )
    for i in range(GAMMA_SHIFT):
        series = series - F.lit(1.0) / (x + F.lit(float(i)))
    return series


def trigamma(x: Column) -> Column:
    """Second derivative of ln Gamma(x) for x > 0."""
    y = x + F.lit(float(GAMMA_SHIFT))
    series = (
        F.lit(1.0) / y + F.lit(0.5) / F.pow(y, 2) + F.lit(1 / 6) / F.pow(y, 3)
        - F.lit(1 / 30) / F.pow(y, 5) + F.lit(1 / 42) / F.pow(y, 7)
        - F.lit(1 / 30) / F.pow(y, 9)
    )
    for i in range(GAMMA_SHIFT):
        series = series + F.lit(1.0) / F.pow(x + F.lit(float(i)), 2)
    return series


#: Terms of the continued fraction of the incomplete beta function.
BETA_TERMS = 2000


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for Student's T with ``df`` degrees of freedom; null if either is null.

    The regularised incomplete beta function at x = df / (df + t^2), by its continued fraction from the
    last term to the first, on the side of its symmetry where that converges fast.
    """
    df = df.cast("double")
    x0 = df / (df + t * t)
    flip = x0 > (df / 2 + 1) / (df / 2 + 2.5)
    half = F.lit(0.5)
    a, b = F.when(flip, half).otherwise(df / 2), F.when(flip, df / 2).otherwise(half)
    x = F.when(flip, t * t / (df + t * t)).otherwise(x0)

    def term(value: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        return F.lit(1.0) + odd / (F.lit(1.0) + even / value)

    fraction = F.aggregate(F.sequence(F.lit(BETA_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda v, m: term(v, m.cast("double")))
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
    tail = F.when(x <= 0, F.lit(0.0)).otherwise(front / fraction)
    return F.when(t.isNotNull() & df.isNotNull(), F.when(flip, F.lit(1.0) - tail).otherwise(tail))
