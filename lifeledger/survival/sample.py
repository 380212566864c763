"""Censored time-to-event samples for any transition between states of the cohort."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.functions import earlier, inclusive_days, replace_null
from lifeledger.functions.values import DAYS_PER_YEAR
from lifeledger.operators.cohort import StudyDates

COVARIATES = ("age_band", "sex", "baseline_any")


@dataclass(frozen=True)
class Transition:
    """From ``origin`` to ``outcome``, stopped by any ``competing`` date.

    ``require`` is a 0/1 column that must be 1. ``unit`` is ``years`` or ``days``.
    """

    origin: str
    outcome: str
    flag: str
    competing: tuple[str, ...]
    require: str | None = None
    unit: str = "years"


# The transitions of the published study.
TRANSITIONS = {
    "base_progression": Transition(
        "entry_date", "progression_date", "progressed",
        ("adj_death_date", "adj_recovery_date", "pre_onset_date")),
    "base_comorbid": Transition(
        "entry_date", "pre_onset_date", "pre_onset",
        ("adj_death_date", "adj_recovery_date", "progression_date")),
    "base_death": Transition(
        "entry_date", "adj_death_date", "death",
        ("adj_recovery_date", "progression_date", "pre_onset_date")),
    "base_recovery": Transition(
        "entry_date", "adj_recovery_date", "recovered",
        ("adj_death_date", "progression_date", "pre_onset_date")),
    "progressed_comorbid": Transition(
        "progression_date", "post_onset_date", "post_onset",
        ("adj_death_date", "adj_recovery_date"), "progressed"),
    "progressed_death": Transition(
        "progression_date", "adj_death_date", "death",
        ("adj_recovery_date", "post_onset_date"), "progressed"),
    "progressed_recovery": Transition(
        "progression_date", "adj_recovery_date", "recovered",
        ("adj_death_date", "post_onset_date"), "progressed"),
    "comorbid_progression": Transition(
        "pre_onset_date", "progression_date", "progressed",
        ("adj_death_date", "adj_recovery_date")),
    "comorbid_death": Transition(
        "pre_onset_date", "adj_death_date", "death",
        ("adj_recovery_date", "progression_date"), "pre_onset"),
    # This one starts at entry although its neighbours start at onset.
    "comorbid_recovery": Transition(
        "entry_date", "adj_recovery_date", "recovered",
        ("adj_death_date", "progression_date"), "pre_onset"),
    "progressed_comorbid_death": Transition(
        "post_onset_date", "adj_death_date", "death",
        ("adj_recovery_date",), "post_onset"),
    "progressed_comorbid_recovery": Transition(
        "post_onset_date", "adj_recovery_date", "recovered",
        ("adj_death_date",), "post_onset"),
    "validate_death": Transition(
        "entry_date", "adj_death_date", "death", ("adj_recovery_date",), unit="days"),
    "validate_recovery": Transition(
        "entry_date", "adj_recovery_date", "recovered", ("adj_death_date",), unit="days"),
}


# The distribution that the study reports for each transition, those whose curves it draws over
# ten years, and those it compares with a Gompertz model.
CHOSEN = {
    "base_progression": "lognormal", "base_comorbid": "weibull", "base_death": "loglogistic", "base_recovery": "lognormal",
    "progressed_comorbid": "weibull", "progressed_death": "loglogistic", "progressed_recovery": "weibull",
    "comorbid_progression": "lognormal", "comorbid_death": "lognormal", "comorbid_recovery": "loglogistic",
    "progressed_comorbid_death": "weibull", "progressed_comorbid_recovery": "lognormal",
}
CURVES = ("base_progression", "base_recovery", "comorbid_progression", "comorbid_death", "progressed_comorbid_recovery")


def _case(transition: Transition, dates: StudyDates) -> tuple[Column, Column, Column, Column]:
    """Whether a row takes part, its days, time and event."""
    future = F.lit(dates.far_future)
    outcome = replace_null(F.col(transition.outcome), future)
    end = F.when(outcome == future, F.lit(dates.study_end)).otherwise(outcome)
    for c in transition.competing:
        end = earlier(end, replace_null(F.col(c), future))
    part = F.col(transition.origin).isNotNull()
    if transition.require:
        part = part & (F.col(transition.require) == 1)
    days = inclusive_days(F.col(transition.origin), end)
    missed = (outcome > end) & (outcome != future)
    time = days.cast("double") if transition.unit == "days" else days / F.lit(DAYS_PER_YEAR)
    return part, days, time, F.when(missed, 0).otherwise(F.col(transition.flag)).cast("int")


def censored(df: DataFrame, transition: Transition, dates: StudyDates) -> DataFrame:
    """(entity_id, days, time, event, covariates) of one transition.

    Follow-up ends at the outcome, or at study end without one, or at the first competing date.
    The event counts only if the outcome lies not after that end. Rows without an origin drop out.
    """
    part, days, time, event = _case(transition, dates)
    return df.where(part).select("entity_id", days.alias("days"), time.alias("time"), event.alias("event"), *COVARIATES)


def censored_all(df: DataFrame, dates: StudyDates, transitions: Mapping[str, Transition] = TRANSITIONS) -> DataFrame:
    """The samples of several transitions under each other, named by ``transition``, in one pass over the cohort."""
    cases = []
    for name, t in transitions.items():
        part, days, time, event = _case(t, dates)
        cases.append(F.when(part, F.struct(
            F.lit(name).alias("transition"), days.alias("days"), time.alias("time"), event.alias("event")
        )))
    taken = F.filter(F.array(*cases), lambda c: c.isNotNull())
    return df.select("entity_id", *COVARIATES, F.inline(taken)).select(
        "transition", "entity_id", "days", "time", "event", *COVARIATES
    )
