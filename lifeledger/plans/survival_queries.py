"""Censored samples, fits and curves over the stand-in cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.plans.registry import query
from lifeledger.plans.roles import DATES, FUTURE, STUDY_END, Tables
from lifeledger.regression.design import Design
from lifeledger.session import cut_lineage, store
from lifeledger.survival import curves, fit, km
from lifeledger.survival.sample import CHOSEN, CURVES, TRANSITIONS, Transition, censored, censored_all


def sample(t: Tables, name: str) -> DataFrame:
    return censored(t.master, TRANSITIONS[name], DATES)


def sample_sql(name: str) -> str:
    tr: Transition = TRANSITIONS[name]
    outcome = f"coalesce({tr.outcome}, {FUTURE})"
    competing = ", ".join(f"coalesce({c}, {FUTURE})" for c in tr.competing)
    require = f"AND {tr.require} = 1" if tr.require else ""
    time = "days::DOUBLE" if tr.unit == "days" else "days / 365.25::DOUBLE"
    return f"""SELECT entity_id, days, round({time}, 8) AS time,
        CASE WHEN o > e AND o <> {FUTURE} THEN 0 ELSE flag END AS event, age_band, sex, baseline_any
      FROM (SELECT *, e - origin + 1 AS days FROM (
        SELECT entity_id, age_band, sex, baseline_any, {tr.origin} AS origin, {tr.flag} AS flag, {outcome} AS o,
          least(CASE WHEN {outcome} = {FUTURE} THEN {STUDY_END} ELSE {outcome} END, {competing}) AS e
        FROM m_master WHERE {tr.origin} IS NOT NULL {require}) a) b"""


def _register_sample(name: str) -> None:
    @query(sample_sql(name), name=f"censored_{name}")
    def run(t: Tables) -> DataFrame:
        out = sample(t, name)
        return out.withColumns({"days": F.col("days").cast("long"), "time": F.round("time", 8)})


for _name in TRANSITIONS:
    _register_sample(_name)


def km_sql(source: str, by: list[str]) -> str:
    keys = "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""WITH n AS (SELECT {keys}days, count(*) AS n, CAST(sum(event) AS BIGINT) AS d FROM ({source}) s GROUP BY {keys}days),
      r AS (SELECT *, CAST(sum(n) OVER ({part} ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)
        AS n_risk FROM n)
      SELECT {keys}days, n_risk, d AS n_event, n - d AS n_censor,
        round(product(1 - d / n_risk::DOUBLE) OVER ({part} ORDER BY days ROWS UNBOUNDED PRECEDING), 6) AS survival FROM r"""


def _km(df: DataFrame, by: list[str]) -> DataFrame:
    out = km.kaplan_meier(df, by)
    return out.withColumns({"days": F.col("days").cast("long"), "survival": F.round("survival", 6)})


@query(km_sql(sample_sql("base_progression"), ["age_band"]))
def kaplan_meier(t: Tables) -> DataFrame:
    return _km(sample(t, "base_progression"), ["age_band"])


@query(km_sql(sample_sql("validate_recovery"), []))
def kaplan_meier_overall(t: Tables) -> DataFrame:
    return _km(sample(t, "validate_recovery"), [])


# From the first sign-up to the first purchase after it, in days, on the event log.
_SIGNUP = """SELECT user_id, CAST(coalesce(bought, last_day) - joined + 1 AS BIGINT) AS days,
    CASE WHEN bought IS NULL THEN 0 ELSE 1 END AS event FROM (
  SELECT user_id, joined, min(CASE WHEN event_type = 'purchase' AND d >= joined THEN d END) AS bought, max(last_day) AS last_day
  FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events) e
    JOIN (SELECT user_id, min(CAST(ts AS DATE)) AS joined FROM events WHERE event_type = 'signup' GROUP BY user_id) s
    USING (user_id), (SELECT max(CAST(ts AS DATE)) AS last_day FROM events) l GROUP BY user_id, joined) u"""


@query(km_sql(_SIGNUP, []))
def kaplan_meier_events(t: Tables) -> DataFrame:
    dated = t.events.select("user_id", "event_type", F.col("ts").cast("date").alias("d"))
    # One row per user, day and type is all that matters, whatever a user's number of events.
    daily = dated.where(F.col("event_type").isin("signup", "purchase")).distinct()
    joined = daily.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("d").alias("joined"))
    bought = daily.where(F.col("event_type") == "purchase").join(joined, on="user_id").where(F.col("d") >= F.col("joined"))
    first = bought.groupBy("user_id").agg(F.min("d").alias("bought"))
    last_day = dated.agg(F.max("d")).first()[0]
    spans = joined.join(first, on="user_id", how="left").select(
        "user_id", (F.datediff(F.coalesce("bought", F.lit(last_day)), "joined") + 1).alias("days"),
        F.col("bought").isNotNull().cast("int").alias("event"))
    return _km(spans, [])


def _events_sql(source: str, horizons, by: list[str]) -> str:
    keys = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {keys}{i} AS cycle, count(*) FILTER (event = 1 AND days <= {365 * i}) AS n_event FROM ({source}) s {group}"
        for i in horizons)


@query(_events_sql(sample_sql("validate_death"), range(1, 11), []))
def events_by_horizon(t: Tables) -> DataFrame:
    return km.events_by(sample(t, "validate_death"), range(1, 11))


@query(_events_sql(sample_sql("validate_recovery"), [4], ["age_band", "sex", "baseline_any"]))
def events_by_stratum(t: Tables) -> DataFrame:
    return km.events_by(sample(t, "validate_recovery"), [4], ["age_band", "sex", "baseline_any"])


# Fits


def _stored_sample(t: Tables, name: str) -> DataFrame:
    """One transition for a fit, which reads it more than once."""
    return store(sample(t.prepared, name))


def _samples(t: Tables) -> DataFrame:
    """The twelve transitions of the study in years, one pass over the cohort."""
    return cut_lineage(censored_all(t.master, DATES, {k: TRANSITIONS[k] for k in CHOSEN}))


def _fits(t: Tables, dists) -> fit.Fits:
    return fit.fit_all(_samples(t), dists, expected=list(CHOSEN))


EVERY = (*fit.DISTRIBUTIONS, "gompertz")
_LEVELS = fit.DEFAULT_LEVELS
_TERMS = {"intercept": "true"} | {
    f"{c}={v}": f"{c} = '{v}'" if isinstance(v, str) else f"{c} = {v}" for c, levels in _LEVELS.items() for v in levels[1:]}
_ALL_SQL = " UNION ALL ".join(f"SELECT '{name}' AS transition, s.* FROM ({sample_sql(name)}) s" for name in CHOSEN)
_KNOWN = " AND ".join(
    f"coalesce({c} IN ({', '.join(repr(v) for v in levels)}), false)" for c, levels in _LEVELS.items())
# Reason why a transition is not fitted, as in the fits: no row, no event, or none in a level that has rows.
_STATUS_SQL = f"""SELECT e.transition, count(s.entity_id) AS n_rows, count(*) FILTER (s.entity_id IS NOT NULL AND NOT timed) AS n_no_time,
    count(*) FILTER (timed AND NOT known) AS n_unknown, count(*) FILTER (timed AND known) AS n_fit,
    count(*) FILTER (timed AND known AND event = 1) AS n_events,
    CASE WHEN count(*) FILTER (timed AND known) = 0 THEN 'no rows'
      WHEN count(*) FILTER (timed AND known AND event = 1) = 0 THEN 'no events' {' '.join(
        f"WHEN count(*) FILTER (timed AND known AND {c} = {v!r}) > 0 AND count(*) FILTER (timed AND known AND event = 1 AND {c} = {v!r}) = 0 "
        f"THEN 'no events in {c}={v}'" for c, levels in _LEVELS.items() for v in levels)} ELSE 'fitted' END AS status
  FROM (VALUES {', '.join(f"('{name}')" for name in CHOSEN)}) e(transition)
    LEFT JOIN (SELECT *, coalesce(days > 0, false) AS timed, {_KNOWN} AS known FROM ({_ALL_SQL}) a) s USING (transition)
  GROUP BY e.transition"""


@query(_STATUS_SQL)
def fit_account(t: Tables) -> DataFrame:
    """Rows of each transition: all, refused for their time or a level, fitted, with an event; and whether it is fitted."""
    fits = _fits(t, ["exponential"])
    rows = [
        (k, *(a[c] for c in ("n_rows", "n_no_time", "n_unknown", "n_fit", "n_events")), fits.status[k, "exponential"])
        for k, a in fits.accounts.items()]
    return t.spark.createDataFrame(
        rows, "transition string, n_rows long, n_no_time long, n_unknown long, n_fit long, n_events long, status string")


def _equation(dist: str, term: str, observed: str) -> str:
    return f"""SELECT transition, '{dist}' AS dist, '{term}' AS term, round(coalesce({observed}, 0), 4) AS fitted FROM a GROUP BY transition"""


@query(f"""WITH st AS ({_STATUS_SQL}), a AS (SELECT s.*, days / 365.25::DOUBLE AS years FROM ({_ALL_SQL}) s JOIN st USING (transition)
             WHERE days > 0 AND {_KNOWN} AND status = 'fitted')
           """ + " UNION ALL ".join(
    [_equation(d, term, f"sum({'ln(years)' if d == 'lognormal' else '1.0'}) FILTER (event = 1 AND {test})")
     for d in EVERY for term, test in _TERMS.items()]
    + [_equation(d, "log_scale", "sum(1.0) FILTER (event = 1)") for d in fit.DISTRIBUTIONS if d != "exponential"]
    + [_equation("gompertz", "shape", "sum(years) FILTER (event = 1)")]))
def fit_score_equations(t: Tables) -> DataFrame:
    """Certificate of every fit: the model side of its likelihood equations. The SQL sums the observed side only."""
    samples = _samples(t)
    found = fit.score_equations(samples, fit.fit_all(samples, EVERY, tol=1e-10))
    # A distribution without a finite optimum is in no row here; the comparison with SQL would show it.
    return found.withColumn("fitted", F.round("fitted", 4) + F.lit(0.0))


_ROUNDED = ("estimate", "se", "lower", "upper")


def _table(t: Tables, dists) -> DataFrame:
    return fit.coefficients(_fits(t, dists), t.spark).withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(name="aft_fit")
def aft_fit(t: Tables) -> DataFrame:
    """All four distributions of all twelve transitions."""
    return _table(t, fit.DISTRIBUTIONS)


@query(f"""WITH g AS (SELECT sex, sum(days / 365.25::DOUBLE) / sum(event) AS m, 1.0 / sum(event) AS v
             FROM ({sample_sql('base_recovery')}) s WHERE days > 0 GROUP BY sex)
           SELECT 'intercept' AS term, round(ln(m), 6) AS estimate, round(sqrt(v), 6) AS se FROM g WHERE sex = 'F'
           UNION ALL SELECT 'sex=M', round(ln(m.m) - ln(f.m), 6), round(sqrt(m.v + f.v), 6)
           FROM g m JOIN g f ON m.sex = 'M' AND f.sex = 'F'""")
def aft_fit_saturated(t: Tables) -> DataFrame:
    """An exponential fit with one covariate has a closed form: time at risk per event in each group."""
    model = fit.fit_models(_stored_sample(t, "base_recovery"), ["exponential"], {"sex": ["F", "M"]})["exponential"]
    return model.table(t.spark).select("term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"))


@query(f"""SELECT age_band, sex, baseline_any, round(time, 8) AS time, event, count(*) AS n
           FROM ({sample_sql('base_progression')}) s WHERE days > 0 GROUP BY ALL""")
def aft_compress(t: Tables) -> DataFrame:
    counts = fit.compress(sample(t, "base_progression"), Design(fit.DEFAULT_LEVELS))
    return counts.withColumn("time", F.round("time", 8))


@query(name="gompertz_fit")
def gompertz_fit(t: Tables) -> DataFrame:
    return _table(t, ["gompertz"])


@query(name="model_selection")
def model_selection(t: Tables) -> DataFrame:
    """Five distributions of all twelve transitions, in the same rounds; a pair without a model says why."""
    return fit.compare_all(_fits(t, EVERY), t.spark).withColumns({c: F.round(c, 4) for c in ("loglik", "aic", "bic")})


@query(name="weibull_report")
def weibull_report(t: Tables) -> DataFrame:
    """The four transitions that the study reports with a Weibull model."""
    fits, out = _fits(t, ["weibull"]), None
    for name in (k for k, dist in CHOSEN.items() if dist == "weibull" and (k, "weibull") in fits.models):
        part = fit.weibull_report(fits.models[name, "weibull"], t.spark).withColumn("transition", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else t.spark.createDataFrame(
        [], "quantity string, term string, estimate double, lower double, upper double, transition string")


def _curves(t: Tables) -> DataFrame:
    """S(t) of the five transitions that have curves, in years 1 to 10, from lognormal models."""
    fits, out = _fits(t, ["lognormal"]), None
    for name in (k for k in CURVES if (k, "lognormal") in fits.models):
        part = curves.survival_grid(t.spark, fits.models[name, "lognormal"]).withColumn("transition", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else t.spark.createDataFrame(
        [], "age_band string, sex string, baseline_any int, year int, survival double, transition string")


@query(name="survival_grid")
def survival_grid(t: Tables) -> DataFrame:
    return _curves(t).withColumn("survival", F.round("survival", 6))


@query(name="survival_grid_wide")
def survival_grid_wide(t: Tables) -> DataFrame:
    return curves.survival_wide(_curves(t), by=["transition", "year"])


@query(f"""WITH g AS (SELECT sex, sum(days / 365.25::DOUBLE) / sum(event) AS m FROM ({sample_sql('base_recovery')}) s
             WHERE days > 0 GROUP BY sex)
           SELECT sex, CAST(y AS INTEGER) AS year, round(exp(-y / m), 6) AS survival FROM g, range(1, 11) r(y)""")
def survival_grid_saturated(t: Tables) -> DataFrame:
    model = fit.fit_models(_stored_sample(t, "base_recovery"), ["exponential"], {"sex": ["F", "M"]})["exponential"]
    return curves.survival_grid(t.spark, model).withColumn("survival", F.round("survival", 6))


_FACTORS = {
    "weibull": {"sex": ["F", "M"]},
    "lognormal": {"age_band": fit.DEFAULT_LEVELS["age_band"]},
    "loglogistic": {"baseline_any": [1, 0]},
}


@query(name="quantile_curve")
def quantile_curve(t: Tables) -> DataFrame:
    """One-factor fits: Weibull by sex, lognormal by age band, loglogistic by baseline."""
    rows, out = cut_lineage(sample(t, "validate_recovery")), None
    for dist, levels in _FACTORS.items():
        model = fit.fit_models(rows, [dist], levels)[dist]
        factor = next(iter(levels))
        part = curves.predict_quantiles(t.spark, model).select(
            F.lit(dist).alias("dist"), F.lit(factor).alias("factor"), F.col(factor).cast("string").alias("level"),
            "p", F.round("time", 4).alias("time"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_custkey, 'open' AS status, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY o_custkey
          UNION ALL SELECT o_custkey, 'filled', count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY o_custkey""")
def wide_to_long(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    return curves.wide_to_long(wide, ["o_custkey"], ["open", "filled"], "status", "n")


@query(name="km_vs_model")
def km_vs_model(t: Tables) -> DataFrame:
    rows = cut_lineage(sample(t, "validate_recovery"))
    model = fit.fit_models(rows, ["weibull"], {"sex": ["F", "M"]})["weibull"]
    return curves.km_vs_model(km.kaplan_meier(rows, ["sex"]), model, ["sex"])
