"""The three stages of a study, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.operators import cohort, cost, markov, matching
from lifeledger.operators.cohort import GRACE_DAYS, StudyDates
from lifeledger.operators.relational import inner
from lifeledger.session import cut_lineage, store

RECOVERY_LAGS = {"op": GRACE_DAYS, "ae": GRACE_DAYS, "ip": GRACE_DAYS, "rx": 0}


@dataclass(frozen=True)
class Inputs:
    """Prepared source tables. See the README for their columns."""

    index_records: DataFrame
    entities: DataFrame
    death_updates: tuple[DataFrame, ...]
    incident_keys: DataFrame
    progression_dates: DataFrame
    conditions: DataFrame
    activity: Mapping[str, DataFrame]


def entry_cohort(inputs: Inputs, dates: StudyDates) -> DataFrame:
    """Incident entities with entry, follow-up, progression and age band."""
    df = inner(cohort.index_event(inputs.index_records, dates, ["record_id"]).drop("record_id"),
               inputs.entities, "entity_id")
    df = cohort.refresh_death(df, inputs.death_updates, ["death_date", "main_cause", "other_cause"])
    df = cohort.incident_only(cohort.min_age(cohort.follow_up(df, dates)), inputs.incident_keys)
    df = cohort.progression(df, inputs.progression_dates, dates)
    return cohort.age_and_band(df).withColumn("cohort_year", F.year("entry_date"))


def reconciled_cohort(inputs: Inputs, dates: StudyDates) -> DataFrame:
    """Entry cohort with baseline flags, causes of death, recovery and reconciled outcomes."""
    df = cohort.baseline_flags(cohort.attach_history(entry_cohort(inputs, dates), inputs.conditions))
    df = cohort.death_cause(df, dates)
    df = cohort.recovery_sources(df, inputs.activity, dates, RECOVERY_LAGS)
    return cohort.reconcile(df, dates)


def master_table(inputs: Inputs, dates: StudyDates) -> DataFrame:
    """One row per incident entity with every dated outcome."""
    df = cohort.onset_before_progression(reconciled_cohort(inputs, dates), dates)
    return cohort.onset_after_progression(df, dates)


def matched_cohort(master: DataFrame) -> DataFrame:
    """1:4 matched cases and controls with a shared index date.

    ``master`` is read by every fit and join, so hand in a checkpointed or stored table.
    """
    scored = matching.propensity(master, "progressed", ["age"], {"sex": "M", "baseline_any": 1}, "cohort_year")
    # The distance is the fitted probability of a second model on the first one's score.
    scored = matching.propensity(scored, "progressed", ["ps"], {}, "cohort_year", "score")
    matched = matching.match_nearest(scored, "entity_id", "progressed", "score", "cohort_year")
    return matching.stack_cohorts([matching.share_case_date(cut_lineage(matched))])


def costed_cohort(indexed: DataFrame, visits: DataFrame, stays: DataFrame, services: DataFrame) -> DataFrame:
    """Condition flags and every cost column after the index date.

    ``indexed`` is read once per kind of record, so hand in a checkpointed or stored table. The parts have a row per
    entity and are stored one after the other, so that the shuffles of one kind of record at a time are on disk.
    """
    df = cost.new_condition_after_index(cost.conditions_before_index(indexed))
    parts = cost.ed_cost(visits, indexed), cost.stay_cost(stays, indexed), cost.classify_visits(services, indexed)
    df = cost.attach_costs(df, *[store(part) for part in parts])
    return cost.psych_cost(cost.total_cost(df))


def population_cost(
    incidence: DataFrame, weights: DataFrame, params: DataFrame, state_costs: DataFrame
) -> DataFrame:
    """Open-cohort cost per calendar year."""
    occupancy = markov.markov_project(markov.start(incidence, weights), params)
    return markov.open_cohort_cost(markov.cohort_cost(markov.state_cost(occupancy, state_costs)))

