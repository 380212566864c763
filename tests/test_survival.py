import math
from datetime import date

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import functions as F

from lifeledger.operators.cohort import DEFAULT_DATES
from lifeledger.survival import curves, fit, km
from lifeledger.survival.sample import CHOSEN, CURVES, TRANSITIONS, censored, censored_all

D = date
FUTURE = DEFAULT_DATES.far_future
MASTER = dict(
    entity_id=1, entry_date=D(2015, 1, 1), progression_date=None, progressed=0, adj_death_date=FUTURE, death=0,
    adj_recovery_date=FUTURE, recovered=0, pre_onset_date=None, pre_onset=0, post_onset_date=None, post_onset=0,
    age_band="10-24", sex="F", baseline_any=0,
)


def one(spark, name, **case):
    row = {**MASTER, **case}

    def kind(k):
        return "date" if k.endswith("date") else "string" if k in ("age_band", "sex") else "int"

    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(k)}" for k in row))
    r = censored(df, TRANSITIONS[name], DEFAULT_DATES).first()
    return None if r is None else (r["days"], r["event"])


def test_censoring(spark):
    whole = (D(2020, 12, 31) - D(2015, 1, 1)).days + 1
    assert one(spark, "base_progression") == (whole, 0)
    event = dict(progression_date=D(2015, 1, 10), progressed=1)
    assert one(spark, "base_progression", **event) == (10, 1)
    assert one(spark, "base_progression", **event, adj_death_date=D(2015, 1, 10), death=1) == (10, 1)
    assert one(spark, "base_progression", **event, adj_death_date=D(2015, 1, 5), death=1) == (5, 0)
    assert one(spark, "base_progression", **event, pre_onset_date=D(2015, 1, 4), pre_onset=1) == (4, 0)
    assert one(spark, "base_recovery", adj_recovery_date=D(2016, 1, 1), recovered=1) == (366, 1)
    assert one(spark, "progressed_death") is None
    assert one(spark, "progressed_death", **event) == ((D(2020, 12, 31) - D(2015, 1, 10)).days + 1, 0)
    assert one(spark, "comorbid_progression", **event) is None
    # This transition counts from entry, its neighbour from onset.
    onset = dict(pre_onset=1, pre_onset_date=D(2015, 3, 1), adj_recovery_date=D(2015, 3, 31), recovered=1)
    assert one(spark, "comorbid_recovery", **onset) == (90, 1)
    assert one(spark, "comorbid_death", **onset) == (31, 0)


def test_kaplan_meier_by_hand(spark):
    rows = [("a", 1, 1), ("a", 2, 0), ("a", 2, 1), ("a", 3, 1), ("b", 1, 0), ("b", 4, 0), ("c", 5, 1), ("c", 5, 1)]
    df = spark.createDataFrame(rows, "g string, days int, event int")
    got = {(r["g"], r["days"]): (r["n_risk"], r["n_event"], r["n_censor"], round(r["survival"], 9)) for r in km.kaplan_meier(df, ["g"]).collect()}
    assert got == {
        ("a", 1): (4, 1, 0, 0.75), ("a", 2): (3, 1, 1, 0.5), ("a", 3): (1, 1, 0, 0.0),
        ("b", 1): (2, 0, 1, 1.0), ("b", 4): (1, 0, 1, 1.0), ("c", 5): (2, 2, 0, 0.0),
    }


@pytest.mark.parametrize("span", [1.0, 7.0, 64.0, 1e9])
def test_kaplan_meier_does_not_depend_on_the_spans(spark, span):
    rng = np.random.default_rng(2)
    rows = [(str(g), int(d), int(e)) for g, d, e in zip(rng.integers(0, 3, 500), rng.integers(1, 300, 500), rng.integers(0, 2, 500))]
    rows += [("0", 400, 1), ("0", 400, 1), ("1", 400, 1), ("1", 500, 0), (None, 3, 1), (None, 9, 0)]
    df = spark.createDataFrame(rows, "g string, days int, event int")
    for by in ([], ["g"]):
        want = {}
        for g in {r[0] for r in rows} if by else [None]:
            own = [r[1:] for r in rows if not by or r[0] == g]
            s = 1.0
            for t in sorted({d for d, _ in own}):
                risk, died = sum(d >= t for d, _ in own), sum(e for d, e in own if d == t)
                s *= 1 - died / risk
                want[g, t] = (risk, died, sum(d == t for d, _ in own) - died, pytest.approx(s, abs=1e-12))
        got = {(r["g"] if by else None, r["days"]): (r["n_risk"], r["n_event"], r["n_censor"], r["survival"]) for r in km.kaplan_meier(df, by, span=span).collect()}
        assert got == want


def test_horizons_are_whole_multiples_of_365(spark):
    df = spark.createDataFrame([(365, 1), (366, 1), (1460, 1), (1461, 1), (100, 0)], "days int, event int")
    got = {r["cycle"]: r["n_event"] for r in km.events_by(df, [1, 4, 5]).collect()}
    assert got == {1: 1, 4: 3, 5: 4}


def simulated(spark, dist, n=20_000, seed=7):
    rng = np.random.default_rng(seed)
    band, sex, base = rng.integers(0, 4, n), rng.integers(0, 2, n), rng.integers(0, 2, n)
    eta = 1.0 + np.array([0.0, 0.3, -0.2, -0.5])[band] + 0.25 * sex - 0.4 * base
    u = rng.random(n)
    if dist == "gompertz":
        a, rate = 0.15, np.exp(-eta)
        t = np.log1p(-a * np.log(u) / rate) / a
    else:
        error = {
            "weibull": np.log(-np.log(u)), "exponential": np.log(-np.log(u)),
            "loglogistic": np.log(u / (1 - u)), "lognormal": rng.standard_normal(n),
        }[dist]
        t = np.exp(eta + (1.0 if dist == "exponential" else 0.7) * error)
    c = rng.exponential(np.exp(1.3), n)
    time, event = np.minimum(t, c), (t <= c).astype(int)
    bands = np.array(["10-24", "25-40", "41-65", "65+"])[band]
    rows = [(float(x), int(e), str(b), "M" if s else "F", int(z)) for x, e, b, s, z in zip(time, event, bands, sex, base)]
    return spark.createDataFrame(rows, "time double, event int, age_band string, sex string, baseline_any int").coalesce(4)


TRUE = np.array([1.0, 0.3, -0.2, -0.5, 0.25, -0.4])


@pytest.mark.parametrize("dist", ["exponential", "weibull", "loglogistic", "lognormal", "gompertz"])
def test_fit_recovers_simulated_parameters(spark, dist):
    df = simulated(spark, dist)
    model = fit.fit_models(df, [dist])[dist]
    sign = -1 if dist == "gompertz" else 1
    errors = np.abs(model.beta - sign * TRUE) / np.sqrt(np.diag(model.cov))[:6]
    assert errors.max() < 3.5 and model.gradient < 1e-3
    if dist == "gompertz":
        assert model.shape == pytest.approx(0.15, abs=0.03)
    elif dist != "exponential":
        assert model.scale == pytest.approx(0.7, abs=0.02)
    if dist == "weibull":
        # The same model by Spark's own estimator.
        x = df.select(
            "time", F.col("event").cast("double").alias("censor"),
            *[(F.col("age_band") == b).cast("double").alias(f"b{i}") for i, b in enumerate(["25-40", "41-65", "65+"])],
            (F.col("sex") == "M").cast("double").alias("m"), F.col("baseline_any").cast("double").alias("h"))
        x = VectorAssembler(inputCols=["b0", "b1", "b2", "m", "h"], outputCol="features").transform(x)
        other = AFTSurvivalRegression(labelCol="time", maxIter=200, tol=1e-9).fit(x)
        assert model.beta[0] == pytest.approx(other.intercept, abs=2e-3)
        assert list(model.beta[1:]) == pytest.approx(list(other.coefficients), abs=2e-3)
        assert model.scale == pytest.approx(other.scale, abs=2e-3)
        report = {(r["quantity"], r["term"]): r for r in fit.weibull_report(model, spark).collect()}
        hr = report[("hazard_ratio", "sex=M")]
        assert hr["estimate"] == pytest.approx(math.exp(-model.beta[4] / model.scale)) and hr["lower"] < hr["estimate"] < hr["upper"]
        assert report[("gamma", "log_scale")]["estimate"] == pytest.approx(1 / model.scale)


def test_likelihood_keeps_the_time_scale_term(spark):
    rows = [(0.5, 1), (1.5, 1), (2.0, 0), (4.0, 1)]
    df = spark.createDataFrame([(t, e, "F") for t, e in rows], "time double, event int, sex string")
    models = fit.fit_models(df, ["exponential", "gompertz"], {"sex": ["F"]})
    m = models["exponential"]
    rate = 3 / 8
    assert m.loglik == pytest.approx(3 * math.log(rate) - rate * 8)
    assert (m.aic, m.bic()) == (pytest.approx(-2 * m.loglik + 2), pytest.approx(-2 * m.loglik + math.log(4)))
    assert models["gompertz"].loglik >= m.loglik


def test_published_scores_agree_on_sample_size():
    # 7 parameters and 6 parameters, from the published AIC and BIC of one sample.
    n7 = math.exp((11285.52 - 11238.96) / 7 + 2)
    n6 = math.exp((11335.68 - 11295.77) / 6 + 2)
    assert n7 == pytest.approx(n6, rel=2e-3) and 5700 < n7 < 5740


def test_selection_prefers_the_true_distribution(spark):
    table = fit.compare_models(simulated(spark, "lognormal", 8000)).collect()
    assert table[0]["dist"] == "lognormal" and len(table) == 5
    assert [r["k"] for r in table if r["dist"] == "exponential"] == [6]


@pytest.mark.parametrize("dist", ["weibull", "lognormal", "loglogistic", "gompertz"])
def test_curve_and_quantile_are_inverse(spark, dist):
    model = fit.fit_models(simulated(spark, dist, 3000), [dist])[dist]
    q = curves.predict_quantiles(spark, model, [0.05, 0.5, 0.9]).withColumn("s", curves.survival(model, F.col("time")))
    for r in q.collect():
        assert 1 - r["s"] == pytest.approx(r["p"], abs=1e-9)
    grid = curves.survival_grid(spark, model)
    assert grid.count() == 160
    assert len(curves.survival_wide(grid).columns) == 17


def test_curve_lies_on_the_product_limit_estimate(spark):
    df = simulated(spark, "weibull").where("age_band = '10-24' and sex = 'F' and baseline_any = 0")
    model = fit.fit_models(df, ["weibull"], {"sex": ["F"]})["weibull"]
    gap = curves.km_vs_model(km.kaplan_meier(df, ["sex"], "time"), model, ["sex"], "time").first()
    assert gap["max_gap"] < 0.05


def test_every_transition_in_one_pass(spark):
    cases = [
        {}, dict(progression_date=D(2015, 1, 10), progressed=1), dict(adj_death_date=D(2016, 1, 1), death=1),
        dict(progression_date=D(2015, 2, 1), progressed=1, post_onset_date=D(2015, 4, 1), post_onset=1),
        dict(pre_onset=1, pre_onset_date=D(2015, 3, 1), adj_recovery_date=D(2015, 3, 31), recovered=1),
    ]
    rows = [tuple({**MASTER, **c, "entity_id": i}.values()) for i, c in enumerate(cases)]
    kind = lambda k: "date" if k.endswith("date") else "string" if k in ("age_band", "sex") else "int"
    df = spark.createDataFrame(rows, ", ".join(f"{k} {kind(k)}" for k in MASTER))
    got = sorted((r["transition"], r["entity_id"], r["days"], r["event"]) for r in censored_all(df, DEFAULT_DATES).collect())
    want = sorted((name, r["entity_id"], r["days"], r["event"]) for name, t in TRANSITIONS.items() for r in censored(df, t, DEFAULT_DATES).collect())
    assert got == want and len({r[0] for r in got}) == len(TRANSITIONS)
    assert set(CURVES) < set(CHOSEN) < set(TRANSITIONS) and len(CHOSEN) == 12


def test_shared_rounds_equal_single_fits_and_thin_transitions_say_so(spark):
    one, two = simulated(spark, "weibull", 2500, 1), simulated(spark, "lognormal", 2500, 2)
    no_event = one.withColumn("event", F.lit(0))
    no_level = one.withColumn("event", F.when(F.col("sex") == "M", 0).otherwise(F.col("event")))
    refused = one.limit(40).withColumn("time", F.lit(-1.0)).unionByName(one.limit(30).withColumn("sex", F.lit("X")))
    named = {"a": one.unionByName(refused), "b": two, "c": no_event, "d": no_level}
    stacked = None
    for name, df in named.items():
        part = df.withColumn("transition", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    dists = ("weibull", "lognormal", "gompertz")
    fits = fit.fit_all(stacked, dists, expected=["a", "e"])
    for name, df in (("a", one), ("b", two)):
        for d, model in fit.fit_models(df, dists).items():
            same = fits.models[name, d]
            assert list(same.beta) == pytest.approx(list(model.beta), abs=1e-6) and same.loglik == pytest.approx(model.loglik, abs=1e-6)
    assert fits.models["a", "weibull"].n_refused == 70 and fits.accounts["a"]["n_rows"] == 2570
    assert fits.status["c", "weibull"] == "no events" and fits.status["d", "gompertz"] == "no events in sex=M" and fits.status["e", "weibull"] == "no rows"
    table = {(r["transition"], r["dist"]): r for r in fit.compare_all(fits, spark).collect()}
    assert len(table) == 15 and table["c", "weibull"]["aic"] is None and table["a", "weibull"]["n_refused"] == 70
    # The equations hold at the fits and not beside them.
    events = {r["transition"]: r["d"] for r in stacked.where("time > 0 AND sex <> 'X'").groupBy("transition").agg(F.sum("event").alias("d")).collect()}
    found = {(r["transition"], r["dist"], r["term"]): r["fitted"] for r in fit.score_equations(stacked, fits).collect()}
    for name in "ab":
        assert found[name, "weibull", "intercept"] == pytest.approx(events[name], abs=1e-4)
        assert found[name, "lognormal", "log_scale"] == pytest.approx(events[name], abs=1e-4)
        assert found[name, "gompertz", "intercept"] == pytest.approx(events[name], abs=1e-4)
