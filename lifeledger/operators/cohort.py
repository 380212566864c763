"""From dated records to one row per entity with reconciled outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.functions import (
    add_days,
    age_band,
    any_column_matches,
    completed_years,
    contains_pattern,
    earlier,
    if_else,
    inclusive_days,
    later,
    null_if,
    replace_null,
)
from lifeledger.operators.aggregates import count_violations, first_per_key, key_set, last_per_key
from lifeledger.operators.relational import code_map, in_keys, left_fill, overwrite, stack
from lifeledger.session import store


@dataclass(frozen=True)
class StudyDates:
    """Fixed points of a study. The sentinels lie outside every real date."""

    accrual_start: date
    accrual_end: date
    study_end: date
    activity_cutoff: date
    far_past: date
    far_future: date


# The published study's calendar, its external-cause letters and the grace period.
DEFAULT_DATES = StudyDates(
    accrual_start=date(2014, 1, 1),
    accrual_end=date(2016, 12, 31),
    study_end=date(2020, 12, 31),
    activity_cutoff=date(2021, 1, 1),
    far_past=date(2000, 1, 1),
    far_future=date(2022, 12, 31),
)
EXTERNAL_CAUSE = "S|T|V|W|X|Y"
GRACE_DAYS = 180
MINIMUM_AGE = 10
#: Rows of (code, condition) that are sent to every task.
SENT_CODES = 100_000

SOURCES = ("op", "ae", "ip", "rx")


def index_event(events: DataFrame, dates: StudyDates, tie_break: Sequence[str] = ()) -> DataFrame:
    """First qualifying record of each entity inside the accrual window."""
    inside = events.where(F.col("event_date").between(dates.accrual_start, dates.accrual_end))
    return first_per_key(inside, ["entity_id"], ["event_date", *tie_break]).withColumnRenamed(
        "event_date", "entry_date"
    )


def refresh_death(master: DataFrame, updates: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Replace the death columns by those of newer files; entities in no file drop out.

    Files come in order of age. Where they disagree the newest file counts, inside a file the first row
    in the order of its columns, so that every entity keeps one row.
    """
    ranked = stack([u.withColumn("_age", F.lit(len(updates) - k)) for k, u in enumerate(updates)])
    newest = first_per_key(ranked, ["entity_id"], ["_age", *columns]).drop("_age")
    return overwrite(master, newest, "entity_id", columns)


def follow_up(df: DataFrame, dates: StudyDates) -> DataFrame:
    """Follow-up end and length; an entity that ends on its entry day or earlier is dropped."""
    return (
        df.withColumn("follow_up_end", replace_null(F.col("death_date"), dates.study_end))
        .withColumn("follow_up_days", inclusive_days(F.col("entry_date"), F.col("follow_up_end")))
        .where(F.col("follow_up_days") > 1)
    )


def min_age(df: DataFrame, years: int = MINIMUM_AGE) -> DataFrame:
    """Keep entities who complete ``years`` years before the year of entry begins."""
    latest_birth = F.make_date(F.year("entry_date") - (years + 1), F.lit(12), F.lit(31))
    return df.where(F.col("birth_date") <= latest_birth)


def incident_only(df: DataFrame, keys: DataFrame) -> DataFrame:
    return in_keys(df, keys.select("entity_id"), "entity_id")


def progression(df: DataFrame, progression_dates: DataFrame, dates: StudyDates) -> DataFrame:
    """Progression date (null if none) and a flag that it falls inside the study.

    An entity with several dates has the first, so every entity keeps one row.
    """
    first = first_per_key(progression_dates.select("entity_id", "progression_date"), ["entity_id"], ["progression_date"])
    joined = left_fill(df, first, "entity_id", {"progression_date": dates.far_future})
    return (
        joined.withColumn("progressed", if_else(F.col("progression_date") <= dates.study_end, 1, 0))
        .withColumn("progression_date", null_if(F.col("progression_date"), dates.far_future))
    )


def age_and_band(df: DataFrame) -> DataFrame:
    return df.withColumn("age", completed_years(F.col("birth_date"), F.col("entry_date"))).withColumn(
        "age_band", age_band(F.col("age"))
    )


def map_conditions(events: DataFrame, code_table: DataFrame) -> DataFrame:
    """Coded records with the name and type of every condition their code stands for."""
    return events.join(code_map(events, "code", code_table, "pattern"), on="code", how="inner").drop("pattern")


def first_conditions(events: DataFrame, code_table: DataFrame) -> DataFrame:
    """First record of each (entity, condition).

    Records are cut to one per (entity, code) before they are mapped, so neither an entity nor a
    code with very many records makes a large group. Records whose code stands for no condition go
    before that, unless the codes that do are too many to be sent to every task.
    """
    mapping = store(code_map(events, "code", code_table, "pattern").drop("pattern"))
    if mapping.count() <= SENT_CODES:
        mapping = F.broadcast(mapping)
        events = events.join(F.broadcast(mapping.select("code").distinct()), on="code", how="left_semi")
    first_code = events.groupBy("entity_id", "code").agg(F.min("event_date").alias("event_date"))
    return first_of_each_condition(first_code.join(mapping, on="code", how="inner"))


def first_of_each_condition(mapped: DataFrame) -> DataFrame:
    return first_per_key(mapped, ["entity_id", "name"], ["event_date", "code", "type"])


def attach_history(master: DataFrame, conditions: DataFrame) -> DataFrame:
    """Add ``history``: the entity's conditions in order of their first date.

    The list has one entry per condition of the code table at most. With it on the row, every
    before / after / first-in-window question below is an expression and needs no further join.
    """
    entry = F.struct("event_date", "name", "code", "type")
    lists = conditions.groupBy("entity_id").agg(F.sort_array(F.collect_list(entry)).alias("history"))
    joined = master.join(lists, on="entity_id", how="left")
    empty = F.array().cast(lists.schema["history"].dataType)
    return joined.withColumn("history", F.coalesce("history", empty))


def condition_flags(df: DataFrame, before: Column, names: Sequence[str]) -> DataFrame:
    """0/1 flags (somatic, mental, either) for conditions strictly before a date."""
    somatic, mental, either = names

    def has(kind: str) -> Column:
        return F.exists("history", lambda c: (c["event_date"] < before) & (c["type"] == kind)).cast("int")

    flagged = df.withColumns({somatic: has("Somatic"), mental: has("Mental")})
    return flagged.withColumn(either, F.greatest(somatic, mental))


def baseline_flags(df: DataFrame) -> DataFrame:
    """Somatic, mental and any condition strictly before entry."""
    return condition_flags(
        df, F.col("entry_date"), ("baseline_somatic", "baseline_mental", "baseline_any")
    )


def death_cause(df: DataFrame, dates: StudyDates, external: str = EXTERNAL_CAUSE) -> DataFrame:
    """Death inside the study, and whether a cause marks it as external."""
    is_external = contains_pattern(F.col("main_cause"), external) | contains_pattern(F.col("other_cause"), external)
    died = replace_null(F.col("death_date") <= dates.study_end, False)
    return df.withColumns({
        "death": died.cast("int"),
        "external_death": (died & is_external).cast("int"),
        "natural_death": (died & ~is_external).cast("int"),
    })


def flag_dx(df: DataFrame, columns: Sequence[str], pattern: str, strict: bool = False) -> DataFrame:
    """``relevant`` = 1 if any diagnosis column carries one of the target codes."""
    test = any_column_matches([F.col(c) for c in columns], pattern, strict)
    return df.withColumn("relevant", if_else(test, 1, 0))


def active_after(df: DataFrame, date_column: str, cutoff: date) -> DataFrame:
    """Keys with a record on or after the cut-off."""
    return key_set(df.where(F.col(date_column) >= F.lit(cutoff)), "entity_id")


def last_relevant(df: DataFrame, date_column: str, active: DataFrame, lag_days: int, name: str) -> DataFrame:
    """Last record date plus a lag, for keys that are not active any more."""
    quiet = df.join(active, on="entity_id", how="left_anti")
    last = last_per_key(quiet, ["entity_id"], date_column)
    return last.select("entity_id", add_days(F.col(date_column), lag_days).alias(name))


def recovery_sources(
    master: DataFrame, records: Mapping[str, DataFrame], dates: StudyDates, lags: Mapping[str, int]
) -> DataFrame:
    """Per source: ``recovered_<s>`` = no record after the cut-off, and ``recovery_<s>`` = last record + lag.

    ``records`` holds frames (entity_id, date) of relevant records. They are stacked and
    aggregated once, so the master is joined once however many sources there are.
    """
    tagged = stack([
        df.select("entity_id", "date", F.lit(name).alias("source")) for name, df in records.items()
    ])
    last = tagged.groupBy("entity_id").agg(
        *[F.max(F.when(F.col("source") == name, F.col("date"))).alias(f"_last_{name}") for name in records]
    )
    derived = {}
    for name in records:
        seen = F.col(f"_last_{name}")
        quiet = replace_null(seen < F.lit(dates.activity_cutoff), True)
        derived[f"recovered_{name}"] = quiet.cast("int")
        derived[f"recovery_{name}"] = F.when(quiet, add_days(seen, lags[name]))
    joined = master.join(last, on="entity_id", how="left").withColumns(derived)
    return joined.drop(*[f"_last_{name}" for name in records])


def drug_filter(rx: DataFrame, drug_list: DataFrame, drug: str, drug_class: str) -> DataFrame:
    """Prescriptions of listed drugs, without one drug when it is given under one class."""
    excluded = contains_pattern(F.col("drug_code"), drug) & contains_pattern(F.col("drug_class"), drug_class)
    return rx.where(~excluded).join(drug_list.distinct(), on="drug_code", how="inner")


def reconcile(df: DataFrame, dates: StudyDates, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Make recovery and death mutually exclusive; the order of the steps matters."""
    past, future = F.lit(dates.far_past), F.lit(dates.far_future)
    filled = [replace_null(F.col(f"recovery_{s}"), past) for s in sources]
    grace = add_days(F.col("entry_date"), GRACE_DAYS)
    no_dates = reduce(lambda a, b: a & b, [f == past for f in filled])
    # Recovered only if every source says so; a known date of any source counts even then.
    every = F.least(*[F.col(f"recovered_{s}") for s in sources])
    known = F.when(no_dates, F.when(every == 1, grace).otherwise(future)).otherwise(later(*filled))
    df = df.withColumns({
        "_every": every, "_known": known, "_death": replace_null(F.col("death_date"), future),
    })
    # A recovery after the cut-off is no recovery, and none is earlier than the grace period.
    late = F.col("_known") >= F.lit(dates.activity_cutoff)
    recovery = later(F.when(late, future).otherwise(F.col("_known")), grace)
    df = df.withColumns({"_late": late, "_recovery": recovery})
    # Whichever comes first wins; on the same day it is death.
    alive = (F.col("_recovery") < F.col("_death")) | (F.col("death") == 0)
    not_recovered = F.col("_late") | (F.col("_every") == 0) | (F.col("_death") <= F.col("_recovery"))
    return df.withColumns({
        "death": (~alive).cast("int"),
        "recovered": (~not_recovered).cast("int"),
        "adj_death_date": F.when(alive, future).otherwise(F.col("_death")),
        "adj_recovery_date": F.when(not_recovered, future).otherwise(F.col("_recovery")),
        "death_date": null_if(F.col("_death"), dates.far_future),
        "recovery_date": null_if(F.col("_recovery"), dates.far_future),
        "natural_death": F.when(alive, 0).otherwise(F.col("natural_death")),
        "external_death": F.when(alive, 0).otherwise(F.col("external_death")),
    }).drop("_every", "_known", "_death", "_late", "_recovery")


def first_onset(df: DataFrame, low: Column, high: Column, prefix: str, closed: bool) -> DataFrame:
    """First condition in each entity's window as ``<prefix>``, ``<prefix>_type`` and ``<prefix>_date``."""
    def inside(c: Column) -> Column:
        upper = c["event_date"] <= high if closed else c["event_date"] < high
        return (c["event_date"] >= low) & upper

    first = F.get(F.filter("history", inside), F.lit(0))
    df = df.withColumn("_first", first)
    return df.withColumns({
        prefix: F.col("_first").isNotNull().cast("int"),
        f"{prefix}_type": replace_null(F.col("_first.type"), "None"),
        f"{prefix}_date": F.col("_first.event_date"),
    }).drop("_first")


def onset_before_progression(df: DataFrame, dates: StudyDates) -> DataFrame:
    """First condition from entry until progression, death, recovery or study end, exclusive."""
    high = earlier(
        F.col("adj_death_date"), F.col("adj_recovery_date"),
        replace_null(F.col("progression_date"), dates.study_end),
    )
    return first_onset(df, F.col("entry_date"), high, "pre_onset", closed=False)


def onset_after_progression(df: DataFrame, dates: StudyDates) -> DataFrame:
    """First condition from progression until death, recovery or study end, inclusive.

    An entity that progresses exactly on the last study day has no such window.
    """
    progressed = F.when(F.col("progression_date") != F.lit(dates.study_end), F.col("progression_date"))
    high = earlier(F.col("adj_death_date"), F.col("adj_recovery_date"), F.lit(dates.study_end))
    return first_onset(df, progressed, high, "post_onset", closed=True)


def timeline_rules() -> dict[str, Column]:
    """Orderings that must hold in a reconciled cohort, as tests for their violation."""
    c = F.col
    done = (c("progressed") == 1) & (c("recovered") == 1)
    return {
        "progression_not_before_recovery": done & (c("progression_date") >= c("adj_recovery_date")),
        "progression_not_before_death": done & (c("progression_date") >= c("adj_death_date")),
        "entry_not_before_recovery": done & (c("entry_date") >= c("adj_recovery_date")),
        "entry_not_before_death": done & (c("entry_date") >= c("adj_death_date")),
        "recovery_inside_grace": done & (add_days(c("entry_date"), GRACE_DAYS) > c("adj_recovery_date")),
        "pre_onset_before_entry": c("pre_onset_date") < c("entry_date"),
        "pre_onset_after_progression": c("pre_onset_date") > c("progression_date"),
        "pre_onset_after_death": c("pre_onset_date") > c("adj_death_date"),
        "pre_onset_after_recovery": c("pre_onset_date") > c("adj_recovery_date"),
        "post_onset_before_entry": c("post_onset_date") < c("entry_date"),
        "post_onset_before_progression": c("post_onset_date") < c("progression_date"),
        "post_onset_after_death": c("post_onset_date") > c("adj_death_date"),
        "post_onset_after_recovery": c("post_onset_date") > c("adj_recovery_date"),
        "recovered_and_dead": (c("recovered") == 1) & (c("death") == 1),
    }


def check_timeline(master: DataFrame) -> DataFrame:
    return count_violations(master, timeline_rules())
