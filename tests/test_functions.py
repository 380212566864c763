import math
from datetime import date
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from lifeledger import functions as fx


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_inclusive_days_counts_both_ends(spark):
    rows = [(date(2020, 1, 1), date(2020, 1, 1)), (date(2020, 1, 1), date(2020, 1, 3)), (date(2020, 1, 3), date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "a date, b date")
    assert [v for v, in values(df, fx.inclusive_days(F.col("a"), F.col("b")))] == [1, 3, -1]


@pytest.mark.parametrize("birth, ref, years", [
    (date(2000, 2, 29), date(2001, 2, 28), 0),
    (date(2000, 2, 29), date(2001, 3, 1), 1),
    (date(2000, 2, 29), date(2004, 2, 29), 4),
    (date(1990, 6, 15), date(2015, 6, 14), 24),
    (date(1990, 6, 15), date(2015, 6, 15), 25),
    (date(1990, 6, 15), date(2015, 7, 1), 25),
])
def test_completed_years(spark, birth, ref, years):
    df = spark.createDataFrame([(birth, ref)], "b date, r date")
    assert values(df, fx.completed_years(F.col("b"), F.col("r"))) == [(years,)]


def test_patterns_and_nulls(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "c string")
    c = F.col("c")
    assert values(df.where(fx.excludes_pattern(c, "A")), "c") == [("B",), (None,)]
    assert values(df.where(fx.contains_pattern(c, "A")), "c") == [("A",)]
    assert values(df, fx.if_else(c == "A", 1, 0)) == [(1,), (0,), (None,)]


def test_any_column_joins_neighbours_unless_strict(spark):
    rows = [("296", "2x", None), ("1", None, "296.25"), (None, None, None), ("296", None, "2")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    columns = [F.col(x) for x in "abc"]
    assert values(df, fx.any_column_matches(columns, "296.2")) == [(True,), (True,), (False,), (False,)]
    assert values(df, fx.any_column_matches(columns, "296.2", strict=True)) == [(False,), (True,), (False,), (False,)]


def test_bad_text(spark):
    df = spark.createDataFrame([("12",), ("x",), ("",), (None,), ("2020-02-30",), ("2020-02-29",)], "t string")
    assert [v for v, in values(df, fx.parse_number(F.col("t")))][:4] == [12.0, None, None, None]
    assert [v for v, in values(df, fx.parse_date(F.col("t")))] == [None, None, None, None, None, date(2020, 2, 29)]


def test_bands_and_rates(spark):
    df = spark.createDataFrame([(24,), (25,), (40,), (41,), (65,), (66,), (None,)], "age int")
    labels = [v for v, in values(df, fx.age_band(F.col("age")))]
    assert labels == ["10-24", "25-40", "25-40", "41-65", "41-65", "65+", None]
    one = spark.createDataFrame([(10.0, 0), (10.0, 1461)], "x double, d int")
    assert [v for v, in values(one, fx.per_person_year(F.col("x"), F.col("d")))] == [None, 2.5]
    assert values(one.limit(1), fx.clip_zero(F.lit(-3)), fx.clip_zero(F.lit(2))) == [(0, 2)]


def test_headers():
    assert fx.normalize_name("Reference Key\n") == "reference_key"
    assert fx.normalize_name("Date of Birth (yyyy-mm-dd)") == "date_of_birth_yyyy_mm_dd_"
    assert fx.normalize_name("LOS..(Acute)") == "los_acute_"


def test_normal_functions(spark):
    points = [-12.0, -6.5, -3.0, -0.7, 0.0, 0.3, 1.96, 5.0, 7.0, 7.2, 9.0, 20.0, 37.0]
    df = spark.createDataFrame([(p,) for p in points], "z double")
    z = F.col("z")
    for p, sf, log_sf, hazard in values(df, "z", fx.normal_sf(z), fx.log_normal_sf(z), fx.normal_hazard(z)):
        exact = 0.5 * math.erfc(p / math.sqrt(2))
        density = math.exp(-p * p / 2) / math.sqrt(2 * math.pi)
        assert sf == pytest.approx(exact, rel=1e-9, abs=1e-300)
        assert log_sf == pytest.approx(math.log(exact), rel=1e-9, abs=1e-14)
        assert hazard == pytest.approx(density / exact, rel=1e-9, abs=1e-300)


def test_normal_quantile(spark):
    points = [1e-9, 0.001, 0.02, 0.025, 0.3, 0.5, 0.77, 0.975, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in points], "p double")
    for p, q in values(df, "p", fx.normal_quantile(F.col("p"))):
        assert q == pytest.approx(NormalDist().inv_cdf(p), rel=1e-10, abs=1e-12)


def test_gamma_family(spark):
    points = [1e-3, 0.2, 0.5, 1.0, 2.5, 10.0, 171.3, 1e6]
    df = spark.createDataFrame([(p,) for p in points], "x double")
    x = F.col("x")
    for p, lg, psi, tri in values(df, "x", fx.lgamma(x), fx.digamma(x), fx.trigamma(x)):
        assert lg == pytest.approx(math.lgamma(p), rel=1e-12, abs=1e-11)
        h = 1e-5 * p
        assert psi == pytest.approx((math.lgamma(p + h) - math.lgamma(p - h)) / (2 * h), rel=1e-6, abs=1e-4)
        # Recurrences hold exactly.
        up = spark.createDataFrame([(p + 1,)], "x double").select(fx.digamma(x), fx.trigamma(x)).first()
        assert up[0] - psi == pytest.approx(1 / p, rel=1e-6, abs=1e-9)
        assert tri - up[1] == pytest.approx(1 / p**2, rel=1e-6, abs=1e-9)


def test_student_tail(spark):
    from lifeledger.functions.special import t_two_sided

    # Closed forms for 1 and 2 degrees of freedom, the normal tail for very many, and Simpson's rule between.
    def simpson(t, df, n=20_000):
        low = math.atan(abs(t) / math.sqrt(df))
        step = (math.pi / 2 - low) / n
        total = sum((1 if i in (0, n) else 4 if i % 2 else 2) * max(math.cos(low + i * step), 0.0) ** (df - 1) for i in range(n + 1))
        return 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * total * step / 3

    cases = [(t, df) for t in (0.0, 0.3, -1.7, 4.0, 12.0) for df in (1.0, 2.0, 7.5, 30.0, 1498.0, 1e6)]
    got = spark.createDataFrame(cases, "t double, df double").withColumn("p", t_two_sided(F.col("t"), F.col("df"))).collect()
    for r in got:
        t, df = r["t"], r["df"]
        want = 1 - 2 * math.atan(abs(t)) / math.pi if df == 1 else 1 - abs(t) / math.sqrt(2 + t * t) if df == 2 else None
        want = math.erfc(abs(t) / math.sqrt(2)) if df == 1e6 else simpson(t, df) if want is None else want
        assert abs(r["p"] - want) < (2e-6 if df == 1e6 else 1e-9), (t, df)
    null = spark.createDataFrame([(None, 3.0)], "t double, df double").select(t_two_sided(F.col("t"), F.col("df"))).first()[0]
    assert null is None
