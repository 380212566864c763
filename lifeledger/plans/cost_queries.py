"""Matching, index dates and cost over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.operators import cost, matching
from lifeledger.operators.aggregates import one_hot
from lifeledger.operators.relational import left_fill
from lifeledger.operators.tables import baseline_table
from lifeledger.plans import study
from lifeledger.plans.registry import query
from lifeledger.plans.roles import CONDITION_CODES, SERVICE_SQL, Tables
from lifeledger.regression import negbin
from lifeledger.session import cut_lineage, store
from lifeledger.survival.curves import level_grid


def _rounded(df: DataFrame, columns, decimals: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), decimals) for c in columns})


def _sql_rounded(columns, decimals: int = 4) -> str:
    return ", ".join(f"round({c}::DOUBLE, {decimals}) AS {c}" for c in columns)


# Matching


def _scored(t: Tables) -> DataFrame:
    kept = t.stored_master.select("entity_id", "cohort_year", "progressed", "age", "sex", "baseline_any",
                           "entry_date", "progression_date", "follow_up_end")
    return matching.propensity(kept, "progressed", ["age"], {"sex": "M", "baseline_any": 1}, "cohort_year")


@query(name="propensity_score")
def propensity_score(t: Tables) -> DataFrame:
    return _scored(t).select("entity_id", "cohort_year", "progressed", F.round("ps", 6).alias("ps"))


_SCORE_TERMS = {"intercept": "1.0", "age": "age", "sex=M": "CASE WHEN sex = 'M' THEN 1.0 ELSE 0.0 END", "baseline_any=1": "baseline_any"}


@query(" UNION ALL ".join(
    f"SELECT cohort_year, '{term}' AS term, round(CAST(sum(progressed * {x}) AS DOUBLE), 4) AS fitted FROM m_master GROUP BY cohort_year"
    for term, x in _SCORE_TERMS.items()))
def propensity_score_equations(t: Tables) -> DataFrame:
    """Certificate of the scores: fitted sums of every covariate, which equal the sums over the cases (all that SQL adds up)."""
    kept = cut_lineage(_scored(t))
    wide = kept.groupBy("cohort_year").agg(*[F.sum(F.col("ps") * F.expr(x)).alias(term) for term, x in _SCORE_TERMS.items()])
    long = wide.unpivot(["cohort_year"], [f"`{term}`" for term in _SCORE_TERMS], "term", "fitted")
    return long.withColumn("fitted", F.round("fitted", 4))


@query("""SELECT entity_id, cohort_year, round(avg(progressed) OVER (PARTITION BY cohort_year, sex), 6) AS ps
          FROM m_master""")
def propensity_saturated(t: Tables) -> DataFrame:
    """With a single two-level covariate the fitted probability is the share in each level."""
    kept = t.stored_master.select("entity_id", "cohort_year", "progressed", "sex")
    scored = matching.propensity(kept, "progressed", [], {"sex": "M"}, "cohort_year")
    return scored.select("entity_id", "cohort_year", F.round("ps", 6).alias("ps"))


@query(name="match_caliper")
def match_caliper(t: Tables) -> DataFrame:
    scored = matching.propensity(_scored(t), "progressed", ["ps"], {}, "cohort_year", "score")
    matched = matching.match_nearest(scored, "entity_id", "progressed", "score", "cohort_year")
    return matched.select("entity_id", "cohort_year", "progressed", "subclass", "match_no",
                          F.round("distance", 8).alias("distance"))


# The sequential procedure step by step: turns, cases from the highest score down, the nearest control not yet used.
_GREEDY = """WITH x AS MATERIALIZED (
    SELECT entity_id, cohort_year, progressed, CAST(entry_date - birth_date AS DOUBLE) AS score FROM m_master),
  y AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cohort_year, score, progressed ORDER BY md5(entity_id::VARCHAR), entity_id) AS no
    FROM x),
  w AS (SELECT cohort_year, 0.25 * stddev_samp(score) AS width FROM x GROUP BY cohort_year),
  s AS MATERIALIZED (SELECT y.cohort_year, entity_id AS case_id, score, width, CAST(turn AS INTEGER) AS turn,
      row_number() OVER (PARTITION BY y.cohort_year ORDER BY turn, score DESC, no) AS k
    FROM y JOIN w USING (cohort_year), range(1, 5) t(turn) WHERE progressed = 1),
  g AS (
    SELECT DISTINCT cohort_year, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS case_id,
      CAST(NULL AS INTEGER) AS turn, CAST(NULL AS BIGINT) AS control, CAST(NULL AS DOUBLE) AS distance FROM s
    UNION ALL
    SELECT cohort_year, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.id) END, case_id, turn, b.id, b.d FROM (
      SELECT g.cohort_year, s.k, g.used, s.case_id, s.turn, (
        SELECT min({'d': abs(c.score - s.score), 's': -c.score, 'n': c.no, 'id': CAST(c.entity_id AS BIGINT)}) FROM y c
        WHERE c.progressed = 0 AND c.cohort_year = g.cohort_year AND NOT list_contains(g.used, CAST(c.entity_id AS BIGINT))
          AND abs(c.score - s.score) <= s.width) AS b
      FROM g JOIN s ON s.cohort_year = g.cohort_year AND s.k = g.k + 1) n),
  p AS (SELECT cohort_year, case_id, turn, control, distance FROM g WHERE control IS NOT NULL),
  q AS (SELECT *, count(*) OVER (PARTITION BY cohort_year, case_id) AS own FROM p),
  z AS (SELECT cohort_year, sum(1.0) / count(DISTINCT case_id) AS scale FROM q GROUP BY cohort_year)
SELECT control AS entity_id, cohort_year, 0 AS progressed, case_id AS subclass, turn AS match_no, distance,
  round(scale / own, 8) AS weight FROM q JOIN z USING (cohort_year)
UNION ALL SELECT case_id, cohort_year, 1, case_id, 0, 0.0, 1.0 FROM p WHERE turn = 1"""


@query(_GREEDY)
def match_days(t: Tables) -> DataFrame:
    """Caliper matching on a score that SQL can state: age at entry in days, nearly all of them different."""
    scored = t.stored_master.select(
        "entity_id", "cohort_year", "progressed", F.datediff("entry_date", "birth_date").cast("double").alias("score"))
    matched = matching.match_nearest(scored, "entity_id", "progressed", "score", "cohort_year")
    return matched.select("entity_id", "cohort_year", "progressed", "subclass", "match_no", "distance",
                          F.round("weight", 8).alias("weight"))


@query(_GREEDY)
def match_days_in_blocks(t: Tables) -> DataFrame:
    """As ``match_days`` with blocks so small that matches cross them; the result is the same."""
    scored = t.stored_master.select(
        "entity_id", "cohort_year", "progressed", F.datediff("entry_date", "birth_date").cast("double").alias("score"))
    matched = matching.match_nearest(scored, "entity_id", "progressed", "score", "cohort_year", block_size=100)
    return matched.select("entity_id", "cohort_year", "progressed", "subclass", "match_no", "distance",
                          F.round("weight", 8).alias("weight"))


@query(name="matched_index_dates")
def matched_index_dates(t: Tables) -> DataFrame:
    return study.matched_cohort(t.stored_master).select(
        "entity_id", "cohort_year", "progressed", "subclass", "index_date", "follow_up_days")


@query(name="matched_cohort_cost")
def matched_cohort_cost(t: Tables) -> DataFrame:
    """The study's own matching, priced: cohort, scores, caliper matching, shared date, costs, arms."""
    indexed, records = store(study.matched_cohort(t.stored_master)), t.prepared
    costed = study.costed_cohort(indexed, records.ed_visits, records.ward_stays, records.services)
    return _rounded(cost.arm_summary(costed), ["mean_cost_py", "mean_cost"])


@query("SELECT entity_id, cohort_year, progressed, subclass, match_no FROM c_matched")
def match_strata(t: Tables) -> DataFrame:
    return t.matched.select("entity_id", "cohort_year", "progressed", "subclass", "match_no")


@query("""SELECT cohort_year, count(*) AS eligible_cases, count(*) AS matched_cases,
            (SELECT count(*) FROM c_matched c WHERE c.progressed = 0 AND c.cohort_year = m.cohort_year) AS matched_controls
          FROM m_master m WHERE progressed = 1 GROUP BY cohort_year""")
def matched_counts(t: Tables) -> DataFrame:
    """Cases that could be matched beside those that are: no case may be lost."""
    eligible = t.stored_master.groupBy("cohort_year").agg(F.count_if(F.col("progressed") == 1).alias("eligible_cases"))
    matched = t.matched.groupBy("cohort_year").agg(
        F.count_if(F.col("progressed") == 1).alias("matched_cases"),
        F.count_if(F.col("progressed") == 0).alias("matched_controls"),
    )
    return eligible.where("eligible_cases > 0").join(matched, "cohort_year")


@query("SELECT entity_id, cohort_year, subclass, entry_date, progression_date FROM c_shared")
def share_case_date(t: Tables) -> DataFrame:
    return matching.share_case_date(t.matched).select(
        "entity_id", "cohort_year", "subclass", "entry_date", "progression_date")


@query("SELECT entity_id, cohort_year, subclass, index_date, follow_up_days FROM c_indexed")
def stack_cohorts(t: Tables) -> DataFrame:
    out = t.indexed.select("entity_id", "cohort_year", "subclass", "index_date", "follow_up_days")
    return out.withColumn("follow_up_days", F.col("follow_up_days").cast("long"))


@query("SELECT entity_id, before_somatic, before_mental, before_any, comorbid FROM c_before")
def conditions_before_index(t: Tables) -> DataFrame:
    out = cost.conditions_before_index(t.indexed)
    return out.select("entity_id", "before_somatic", "before_mental", "before_any", "comorbid")


@query("SELECT entity_id, new_condition FROM c_flagged")
def new_condition_after_index(t: Tables) -> DataFrame:
    return cost.new_condition_after_index(t.indexed).select("entity_id", "new_condition")


# Utilisation


@query("SELECT entity_id, ed_episodes, ed_cost FROM c_ed")
def ed_cost(t: Tables) -> DataFrame:
    return cost.ed_cost(t.ed_visits, t.indexed)


_IP = ["los_general", "los_high", "los_icu", "los_psy", "los_total", "ip_general_cost", "ip_high_cost",
       "ip_icu_cost", "ip_psy_cost", "ip_cost"]


@query(f"SELECT entity_id, {_sql_rounded(_IP)} FROM c_ip")
def inpatient_cost(t: Tables) -> DataFrame:
    return _rounded(cost.stay_cost(t.ward_stays, t.indexed), _IP)


@query("SELECT * FROM c_services")
def outpatient_window(t: Tables) -> DataFrame:
    return cost.outpatient_window(t.services, t.indexed)


def _register_class(name: str, rule: str) -> None:
    price = cost.SERVICE_PRICES[name]

    @query(f"""SELECT entity_id, count(DISTINCT visit_date) AS {name}_episodes,
                 count(DISTINCT visit_date) * {price} AS {name}_cost FROM c_services WHERE {rule} GROUP BY entity_id""",
           name=f"op_{name}" if name != "injection" else "op_injection")
    def run(t: Tables) -> DataFrame:
        return cost.classify_visits(t.services, t.indexed, [name])


for _name, _rule in SERVICE_SQL.items():
    _register_class(_name, _rule)


_ALL_OP = [f"{c}_{kind}" for c in SERVICE_SQL for kind in ("episodes", "cost")]


@query(f"""SELECT entity_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _ALL_OP)} FROM c_op
           WHERE {' + '.join(f'{c}_episodes' for c in SERVICE_SQL)} > 0""")
def op_all_classes(t: Tables) -> DataFrame:
    return cost.classify_visits(t.services, t.indexed)


_TOTALS = ["ed_cost", "ip_cost", "op_episodes", "op_cost", "overall_cost"]


@query(f"SELECT entity_id, {_sql_rounded(_TOTALS)} FROM c_costed")
def total_cost(t: Tables) -> DataFrame:
    return _rounded(t.costed.select("entity_id", *_TOTALS), _TOTALS)


_PSYCH = ["op_psy_cost", "ip_psy_cost", "overall_psy_cost"]


@query(f"SELECT entity_id, {_sql_rounded(_PSYCH)} FROM c_costed")
def psych_cost(t: Tables) -> DataFrame:
    return _rounded(t.costed.select("entity_id", *_PSYCH), _PSYCH)


@query("""SELECT progressed, count(*) AS n, round(avg(overall_cost / (follow_up_days / 365.25::DOUBLE)), 4) AS mean_cost_py,
            round(avg(overall_cost), 4) AS mean_cost FROM c_costed WHERE follow_up_days > 0 GROUP BY progressed""")
def arm_summary(t: Tables) -> DataFrame:
    return _rounded(cost.arm_summary(t.costed), ["mean_cost_py", "mean_cost"])


_WARDS = ["los_general", "los_psy", "los_high", "los_icu", "los_total"]


@query("SELECT progressed, count(*) AS n, " + ", ".join(
    f"round(avg({w} / (follow_up_days / 365.25::DOUBLE)), 6) AS mean_{w}_py, "
    f"round(stddev_samp({w} / (follow_up_days / 365.25::DOUBLE)), 6) AS sd_{w}_py" for w in _WARDS
) + " FROM c_costed WHERE follow_up_days > 0 GROUP BY progressed")
def ward_summary(t: Tables) -> DataFrame:
    return cost.ward_summary(t.costed, 6)


_RATES = [f"{c}_py" for c in cost.RATE_COLUMNS]


@query(f"SELECT entity_id, {_sql_rounded(_RATES)} FROM c_rates")
def cost_rates(t: Tables) -> DataFrame:
    return _rounded(t.rates.select("entity_id", *_RATES), _RATES)


_SUMMARY = """SELECT type, state, setting, round(avg(v), 4) AS cost,
    round(avg(v) - 1.96 * (stddev_samp(v) / sqrt(count(v))), 4) AS cost_lower,
    round(avg(v) + 1.96 * (stddev_samp(v) / sqrt(count(v))), 4) AS cost_upper
  FROM (SELECT CASE WHEN progressed = 1 AND new_condition = 1 THEN 'TRD-comorbid' WHEN new_condition = 1
      THEN 'NTRD-comorbid' WHEN progressed = 1 THEN 'TRD' ELSE 'NTRD' END AS state, s.type, s.setting, s.v
    FROM c_rates, LATERAL (VALUES ('All-cause', 'Accident & Emergency', ed_cost_py), ('All-cause', 'Outpatient', op_cost_py),
      ('All-cause', 'Inpatient', ip_cost_py), ('All-cause', 'Overall', overall_cost_py),
      ('Psychiatric', 'Outpatient', op_psy_cost_py), ('Psychiatric', 'Inpatient', ip_psy_cost_py),
      ('Psychiatric', 'Overall', overall_psy_cost_py)) s(type, setting, v)) l
  WHERE setting {} 'Overall' GROUP BY type, state, setting"""


@query(_SUMMARY.format("<>"))
def stacked_summary(t: Tables) -> DataFrame:
    table = _rounded(cost.state_cost_table(t.rates), ["cost", "cost_lower", "cost_upper"])
    return cost.stacked_summary(table, overall=False)


@query(_SUMMARY.format("="))
def stacked_summary_overall(t: Tables) -> DataFrame:
    table = _rounded(cost.state_cost_table(t.rates), ["cost", "cost_lower", "cost_upper"])
    return cost.stacked_summary(table, overall=True)


_NAMES = [name for _, name, _ in CONDITION_CODES]
_HISTORY = ", ".join(f"max(CASE WHEN name = '{n}' THEN 1 ELSE 0 END) AS {n}" for n in _NAMES)


def _with_history(df: DataFrame) -> DataFrame:
    """One 0/1 column per condition the entity had before entry."""
    records = df.select("entity_id", "entry_date", F.inline("history"))
    before = records.where(F.col("event_date") < F.col("entry_date"))
    history = one_hot(before, "entity_id", "name", _NAMES)
    return left_fill(df, history, "entity_id", {n: 0 for n in _NAMES})


_CONTINUOUS = ["age", "follow_up_days"]
_CATEGORICAL = {
    "age_band": ["10-24", "25-40", "41-65", "65+"], "sex": ["F", "M"], "baseline_somatic": [0, 1],
    "baseline_mental": [0, 1], **{n: [0, 1] for n in _NAMES},
}
_DIGITS = {"mean_0": 4, "mean_1": 4, "sd_0": 4, "sd_1": 4, "share_0": 6, "share_1": 6, "smd": 6}


def _table_sql(source: str) -> str:
    """Baseline table of a source with one row per entity, by ``progressed``."""
    arms = "FILTER (progressed = 0)", "FILTER (progressed = 1)"
    continuous = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, avg({c}) {arms[0]} AS m0, avg({c}) {arms[1]} AS m1, "
        f"stddev_samp({c}) {arms[0]} AS s0, stddev_samp({c}) {arms[1]} AS s1 FROM a" for c in _CONTINUOUS)
    levels = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, '{v}' AS level, (count(*) FILTER (progressed = 0 AND {c}::VARCHAR = '{v}'))::DOUBLE AS k0, "
        f"(count(*) FILTER (progressed = 1 AND {c}::VARCHAR = '{v}'))::DOUBLE AS k1 FROM a"
        for c, values in _CATEGORICAL.items() for v in values)
    return f"""WITH h AS (SELECT entity_id, {_HISTORY} FROM r_conditions JOIN m_master USING (entity_id)
        WHERE event_date < entry_date GROUP BY entity_id),
      a AS (SELECT m.*, {', '.join(f'coalesce(h.{n}, 0) AS {n}' for n in _NAMES)} FROM ({source}) m LEFT JOIN h USING (entity_id)),
      n AS (SELECT count(*) {arms[0]} AS n_0, count(*) {arms[1]} AS n_1 FROM a),
      c AS ({continuous}), l AS ({levels}), p AS (SELECT *, k0 / n_0 AS p0, k1 / n_1 AS p1 FROM l, n)
      SELECT n_0, n_1, variable, CAST(NULL AS VARCHAR) AS level, round(m0, 4) AS mean_0, round(m1, 4) AS mean_1,
        round(s0, 4) AS sd_0, round(s1, 4) AS sd_1, NULL::DOUBLE AS count_0, NULL::DOUBLE AS count_1,
        NULL::DOUBLE AS share_0, NULL::DOUBLE AS share_1,
        round(abs(m0 - m1) / nullif(sqrt((s0 * s0 + s1 * s1) / 2), 0), 6) AS smd FROM c, n
      UNION ALL SELECT n_0, n_1, variable, level, NULL, NULL, NULL, NULL, k0, k1, round(p0, 6), round(p1, 6),
        round(abs(p0 - p1) / nullif(sqrt((p0 * (1 - p0) + p1 * (1 - p1)) / 2), 0), 6) FROM p"""


def _table(df: DataFrame) -> DataFrame:
    table = baseline_table(_with_history(df), "progressed", _CONTINUOUS, _CATEGORICAL)
    return table.withColumns({c: F.round(c, d) for c, d in _DIGITS.items()})


@query(_table_sql("SELECT * FROM c_indexed WHERE follow_up_days > 0"))
def baseline_table_matched(t: Tables) -> DataFrame:
    return _table(cut_lineage(t.indexed.where(F.col("follow_up_days") > 0)))


@query(_table_sql("SELECT * FROM m_master WHERE follow_up_days > 0 AND age <= 25"))
def baseline_table_unmatched(t: Tables) -> DataFrame:
    """Before matching, the younger entities only."""
    return _table(t.stored_master.where((F.col("follow_up_days") > 0) & (F.col("age") <= 25)))


# Regression


# The cost models of the study: response, levels (all covariates if none are named), whether follow-up is the offset.
_MODELS = {
    "ip_cost": ("ip_cost", None, True),
    "overall_psy_cost_py": ("overall_psy_cost_py", None, False),
    "null": ("overall_cost_py", {}, False),
    "null_offset": ("overall_cost", {}, True),
    "progressed": ("overall_cost_py", {"progressed": [0, 1]}, False),
}


def _offset(by_time: bool):
    return F.log(F.col("follow_up_days") / 365.25) if by_time else None


def _model(t: Tables, name: str) -> negbin.CostModel:
    """A one-day window inside a longer stay has a negative prorated cost: such rows are refused and counted."""
    y, levels, by_time = _MODELS[name]
    return negbin.fit_negbin(t.stored_rates, y, levels, offset=_offset(by_time), negative="refuse")


@query(name="nb_glm")
def nb_glm(t: Tables) -> DataFrame:
    return negbin.report(_model(t, "ip_cost"), t.spark, 6)


@query(name="nb_glm_rate")
def nb_glm_rate(t: Tables) -> DataFrame:
    return negbin.report(_model(t, "overall_psy_cost_py"), t.spark, 6)


@query("SELECT 'intercept' AS term, round(avg(overall_cost_py), 2) AS estimate FROM c_rates WHERE overall_cost_py >= 0",
       name="nb_glm_null")
def nb_glm_null(t: Tables) -> DataFrame:
    """The intercept of a log-link model without covariates is the log of the mean."""
    return negbin.report(_model(t, "null"), t.spark, 2).select("term", "estimate")


@query(name="nb_glm_null_offset")
def nb_glm_null_offset(t: Tables) -> DataFrame:
    return negbin.report(_model(t, "null_offset"), t.spark, 4)


@query("""SELECT progressed, round(avg(overall_cost_py), 2) AS cost FROM c_rates WHERE overall_cost_py >= 0 GROUP BY progressed""")
def nb_glm_saturated(t: Tables) -> DataFrame:
    """With one covariate the fitted values are the group means."""
    model = _model(t, "progressed")
    return level_grid(t.spark, model).select(
        "progressed", F.round(F.exp(model.design.linear(model.beta)), 2).alias("cost"))


def _account_sql(name: str) -> str:
    y, levels, by_time = _MODELS[name]
    own = negbin.COST_LEVELS if levels is None else levels
    known = " AND ".join(["true", *(f"coalesce({c} IN ({', '.join(repr(v) for v in vs)}), false)" for c, vs in own.items())])
    missing = f"({y} IS NULL" + (" OR follow_up_days IS NULL OR follow_up_days <= 0)" if by_time else ")")
    return f"""SELECT '{name}' AS model, count(*) AS n_rows, count(*) FILTER (missing) AS n_missing,
        count(*) FILTER (NOT missing AND {y} < 0) AS n_negative, count(*) FILTER (NOT missing AND {y} >= 0 AND NOT known) AS n_unknown,
        count(*) FILTER (NOT missing AND {y} >= 0 AND known) AS n_fit,
        round(sum({y}) FILTER (NOT missing AND {y} >= 0 AND known), 2) AS sum_y
      FROM (SELECT *, {missing} AS missing, {known} AS known FROM c_rates) r"""


@query(" UNION ALL ".join(_account_sql(name) for name in _MODELS))
def cost_fit_account(t: Tables) -> DataFrame:
    """Rows of every cost model: all, refused by reason, fitted; each row of the study is in one of them."""
    out = None
    for name, (y, levels, by_time) in _MODELS.items():
        own = negbin.account(t.stored_rates, y, levels, _offset(by_time))
        part = own.select(F.lit(name).alias("model"), *own.columns)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("sum_y", F.round("sum_y", 2))


@query(" UNION ALL ".join(
    f"SELECT model, n_fit, sum_y, CAST(0.0 AS DOUBLE) AS largest_score FROM ({_account_sql(name)}) a" for name in _MODELS))
def cost_score_equations(t: Tables) -> DataFrame:
    """Certificate of the cost models: the largest score at the estimates is zero, over all rows that may be fitted."""
    rows = []
    for name in _MODELS:
        m = _model(t, name)
        rows.append((name, m.account["n_fit"], round(m.account["sum_y"], 2), m.gradient / m.n))
    made = t.spark.createDataFrame(rows, "model string, n_fit long, sum_y double, largest_score double")
    return made.withColumns({"largest_score": F.round("largest_score", 6), "sum_y": F.round("sum_y", 2)})


@query(name="exp_coef_ci")
def exp_coef_ci(t: Tables) -> DataFrame:
    """Profile-likelihood intervals of the rate model."""
    model = _model(t, "overall_psy_cost_py")
    return negbin.report(model, t.spark, limits=negbin.profile_limits(model))


_RATE_TERMS = ["intercept", *(f"{c}={v}" for c, vs in negbin.COST_LEVELS.items() for v in vs[1:])]


@query("SELECT term, side, CAST(3.841459 AS DOUBLE) AS fall, CAST(0.0 AS DOUBLE) AS score FROM (VALUES "
       + ", ".join(f"('{term}')" for term in _RATE_TERMS) + ") t(term), (VALUES ('lower'), ('upper')) s(side) "
       "WHERE (SELECT count(*) FROM c_rates WHERE overall_psy_cost_py >= 0) > 0")
def profile_equations(t: Tables) -> DataFrame:
    """Certificate of the profile intervals: the fall of twice the log-likelihood, and the score in the other terms."""
    model = _model(t, "overall_psy_cost_py")
    rows = [(model.design.terms[j], "lower" if side < 0 else "upper", end.drop, end.score / model.n)
            for (j, side), end in negbin.profile_limits(model).items()]
    made = t.spark.createDataFrame(rows, "term string, side string, fall double, score double")
    return made.withColumns({c: F.round(c, 6) for c in ("fall", "score")})


@query(name="dispersion")
def dispersion(t: Tables) -> DataFrame:
    return negbin.dispersion(_model(t, "overall_psy_cost_py"), t.spark)


@query(name="predict_link_se")
def predict_link_se(t: Tables) -> DataFrame:
    model = _model(t, "overall_psy_cost_py")
    return negbin.predict(model, level_grid(t.spark, model))


_STATES = {
    "NTRD": ["intercept"],
    "TRD": ["intercept", "progressed=1"],
    "NTRD comorbid": ["intercept", "new_condition=1"],
    "TRD comorbid": ["intercept", "progressed=1", "new_condition=1"],
}


@query(name="contrast")
def contrast(t: Tables) -> DataFrame:
    """Cost of each state, by the delta method and by the sum of profile ends."""
    model = _model(t, "overall_psy_cost_py")
    limits = negbin.profile_limits(model)
    both = [negbin.contrast(model, t.spark, _STATES, m, limits).withColumn("mode", F.lit(m)) for m in ("delta", "endpoint_sum")]
    return both[0].unionByName(both[1])
