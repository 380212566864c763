"""Cohort construction over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.operators import cohort
from lifeledger.operators.cohort import GRACE_DAYS
from lifeledger.plans import study
from lifeledger.plans.registry import query
from lifeledger.plans.roles import (
    CUTOFF,
    DATES,
    ED_COLUMNS,
    EVERY_PROGRESSION,
    EXCLUDED_DRUG,
    RELEVANT_CODES,
    STAY_COLUMNS,
    Tables,
    _sql_any,
)


@query("SELECT entity_id, entry_date, sex, birth_date, district FROM m_index")
def index_event(t: Tables) -> DataFrame:
    return t.indexed_entities


@query("""SELECT entity_id, entry_date, u.death_date, u.main_cause, u.other_cause FROM m_index JOIN (
            SELECT entity_id, death_date, main_cause, other_cause FROM (
              SELECT *, 0 AS age FROM (SELECT entity_id, death_date + 30 AS death_date, 'revised' AS main_cause, other_cause
                FROM r_death WHERE death_date IS NOT NULL AND entity_id % 3 = 0) a
              UNION ALL SELECT *, 1 FROM (SELECT entity_id, death_date, main_cause, other_cause FROM r_death WHERE entity_id % 5 <> 0) b
            ) f QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY age) = 1) u USING (entity_id)""")
def refresh_death(t: Tables) -> DataFrame:
    """Two files that disagree: the newer one moves every third entity's death by 30 days and gives another cause."""
    columns = ["death_date", "main_cause", "other_cause"]
    older = t.indexed_entities.select(
        "entity_id", "entry_date", F.lit(None).cast("date").alias("death_date"),
        F.lit(None).cast("string").alias("main_cause"), F.lit(None).cast("string").alias("other_cause"))
    deaths = t.death_updates
    first_file = deaths.where(F.col("entity_id") % 5 != 0)
    second_file = deaths.where(F.col("death_date").isNotNull() & (F.col("entity_id") % 3 == 0)).withColumns({
        "death_date": F.date_add("death_date", 30), "main_cause": F.lit("revised")})
    return cohort.refresh_death(older, [first_file, second_file], columns)


@query("SELECT entity_id, entry_date, death_date, follow_up_end, follow_up_days FROM m_follow")
def follow_up(t: Tables) -> DataFrame:
    fresh = cohort.refresh_death(t.indexed_entities, [t.death_updates], ["death_date", "main_cause", "other_cause"])
    out = cohort.follow_up(fresh, DATES).select("entity_id", "entry_date", "death_date", "follow_up_end", "follow_up_days")
    return out.withColumn("follow_up_days", F.col("follow_up_days").cast("long"))


@query("SELECT entity_id, entry_date, birth_date FROM m_index WHERE birth_date <= make_date(year(entry_date) - 11, 12, 31)")
def min_age_filter(t: Tables) -> DataFrame:
    return cohort.min_age(t.indexed_entities).select("entity_id", "entry_date", "birth_date")


@query("SELECT entity_id, entry_date FROM m_index WHERE entity_id IN (SELECT entity_id FROM r_incident)")
def incident_only(t: Tables) -> DataFrame:
    return cohort.incident_only(t.indexed_entities, t.incident_keys).select("entity_id", "entry_date")


@query("SELECT entity_id, entry_date, progression_date, progressed FROM m_progression")
def progression(t: Tables) -> DataFrame:
    return study.entry_cohort(t.inputs, DATES).select("entity_id", "entry_date", "progression_date", "progressed")


@query("SELECT entity_id, cohort_year, age, age_band FROM m_entry")
def age_band(t: Tables) -> DataFrame:
    return study.entry_cohort(t.inputs, DATES).select("entity_id", "cohort_year", "age", "age_band")


@query("SELECT entity_id, event_date, code, name, type FROM r_mapped")
def map_conditions(t: Tables) -> DataFrame:
    return cohort.map_conditions(t.diagnoses, t.code_table)


@query("SELECT entity_id, event_date, code, name, type FROM r_conditions")
def first_of_each_condition(t: Tables) -> DataFrame:
    return cohort.first_conditions(t.diagnoses, t.code_table)


@query("SELECT entity_id, baseline_somatic, baseline_mental, baseline_any FROM m_baseline")
def baseline_flags(t: Tables) -> DataFrame:
    flagged = cohort.baseline_flags(cohort.attach_history(study.entry_cohort(t.inputs, DATES), t.conditions))
    return flagged.select("entity_id", "baseline_somatic", "baseline_mental", "baseline_any")


@query("SELECT entity_id, death, external_death, natural_death FROM m_cause")
def death_cause(t: Tables) -> DataFrame:
    out = cohort.death_cause(study.entry_cohort(t.inputs, DATES), DATES)
    return out.select("entity_id", "death", "external_death", "natural_death")


@query(f"""SELECT entity_id, ship_date AS date, 'op' AS source, CASE WHEN {_sql_any(['code'], RELEVANT_CODES)} THEN 1 ELSE 0 END
            AS relevant FROM r_lines
          UNION ALL SELECT entity_id, attend_date, 'ae', CASE WHEN {_sql_any(ED_COLUMNS, RELEVANT_CODES)} THEN 1 ELSE 0 END FROM r_ed
          UNION ALL SELECT entity_id, discharge_date, 'ip', CASE WHEN {_sql_any(STAY_COLUMNS, RELEVANT_CODES)} THEN 1 ELSE 0 END
            FROM r_stays""")
def relevant_dx_flag(t: Tables) -> DataFrame:
    from lifeledger.operators.relational import stack

    def flagged(df: DataFrame, columns: list[str], when: str, source: str) -> DataFrame:
        return cohort.flag_dx(df, columns, RELEVANT_CODES).select(
            "entity_id", F.col(when).alias("date"), F.lit(source).alias("source"), "relevant")

    return stack([
        flagged(t.outpatient_dx, ["dx_code"], "visit_date", "op"),
        flagged(t.ed_visits, ED_COLUMNS, "attend_date", "ae"),
        flagged(t.ward_stays, STAY_COLUMNS, "discharge_date", "ip"),
    ])


def _of_all_sources(f) -> DataFrame:
    from lifeledger.operators.relational import stack

    return stack([f(source).withColumn("source", F.lit(source)) for source in cohort.SOURCES])


@query(f"SELECT DISTINCT source, entity_id FROM r_activity WHERE date >= {CUTOFF}")
def still_active_keys(t: Tables) -> DataFrame:
    return _of_all_sources(lambda s: cohort.active_after(t.activity[s], "date", DATES.activity_cutoff))


@query(f"""SELECT source, entity_id, max(date) + CASE WHEN source = 'rx' THEN 0 ELSE {GRACE_DAYS} END AS recovery FROM r_activity
           GROUP BY source, entity_id HAVING max(date) < {CUTOFF}""")
def last_relevant_date(t: Tables) -> DataFrame:
    def of_source(s: str) -> DataFrame:
        active = cohort.active_after(t.activity[s], "date", DATES.activity_cutoff)
        return cohort.last_relevant(t.activity[s], "date", active, study.RECOVERY_LAGS[s], "recovery")

    return _of_all_sources(of_source)


@query("SELECT entity_id, " + ", ".join(f"recovered_{s}, recovery_{s}" for s in cohort.SOURCES) + " FROM m_sources")
def recovery_date_per_source(t: Tables) -> DataFrame:
    out = cohort.recovery_sources(study.entry_cohort(t.inputs, DATES), t.activity, DATES, study.RECOVERY_LAGS)
    return out.select("entity_id", *[c for s in cohort.SOURCES for c in (f"recovered_{s}", f"recovery_{s}")])


@query("SELECT entity_id, drug_code, drug_class, start_date, end_date FROM r_rx_kept")
def drug_class_filter(t: Tables) -> DataFrame:
    return cohort.drug_filter(t.prescriptions, t.drug_list, *EXCLUDED_DRUG)


_OUTCOMES = [
    "entity_id", "entry_date", "death_date", "recovery_date", "adj_death_date", "adj_recovery_date",
    "death", "recovered", "natural_death", "external_death",
]


@query(f"SELECT {', '.join(_OUTCOMES)} FROM m_reconciled")
def reconcile_outcomes(t: Tables) -> DataFrame:
    return study.reconciled_cohort(t.inputs, DATES).select(*_OUTCOMES)


@query("SELECT entity_id, pre_onset, pre_onset_type, pre_onset_date FROM m_onset1")
def onset_before_progression(t: Tables) -> DataFrame:
    out = cohort.onset_before_progression(study.reconciled_cohort(t.inputs, DATES), DATES)
    return out.select("entity_id", "pre_onset", "pre_onset_type", "pre_onset_date")


@query("SELECT entity_id, progression_date, post_onset, post_onset_type, post_onset_date FROM m_master")
def onset_after_progression(t: Tables) -> DataFrame:
    return t.master.select("entity_id", "progression_date", "post_onset", "post_onset_type", "post_onset_date")


_DONE = "progressed = 1 AND recovered = 1"
_RULES = {
    "progression_not_before_recovery": f"{_DONE} AND progression_date >= adj_recovery_date",
    "progression_not_before_death": f"{_DONE} AND progression_date >= adj_death_date",
    "entry_not_before_recovery": f"{_DONE} AND entry_date >= adj_recovery_date",
    "entry_not_before_death": f"{_DONE} AND entry_date >= adj_death_date",
    "recovery_inside_grace": f"{_DONE} AND entry_date + {GRACE_DAYS} > adj_recovery_date",
    "pre_onset_before_entry": "pre_onset_date < entry_date",
    "pre_onset_after_progression": "pre_onset_date > progression_date",
    "pre_onset_after_death": "pre_onset_date > adj_death_date",
    "pre_onset_after_recovery": "pre_onset_date > adj_recovery_date",
    "post_onset_before_entry": "post_onset_date < entry_date",
    "post_onset_before_progression": "post_onset_date < progression_date",
    "post_onset_after_death": "post_onset_date > adj_death_date",
    "post_onset_after_recovery": "post_onset_date > adj_recovery_date",
    "recovered_and_dead": "recovered = 1 AND death = 1",
}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER ({test}) AS violations FROM m_master" for name, test in _RULES.items()),
    ctes={"r_progression": EVERY_PROGRESSION})
def timeline_checks(t: Tables) -> DataFrame:
    """Violations over every progression: dates that break a rule are counted here, not taken out before."""
    return cohort.check_timeline(t.unchecked_master)
