"""Utilisation after an index date and its price."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.functions import (
    clip_zero,
    contains_pattern,
    excludes_pattern,
    inclusive_days,
    parse_number,
    per_person_year,
    replace_null,
)
from lifeledger.operators.aggregates import first_per_key, rate_summary
from lifeledger.operators.cohort import condition_flags
from lifeledger.operators.relational import any_rule, join_window, left_fill, sort_by_levels

# Price of one emergency visit, and price per day by ward.
ED_PRICE = 1230
WARD_TARIFFS = {"general": 5100, "psy": 2340, "high": 13650, "icu": 24400}

# Outpatient classes, their code rules and prices.
COMMUNITY = "C - Community Service"
COMMUNITY_GENERAL = ["CGAS", "DH", "MPMG", "MPMR", "PC", "PCR", "PCNC", "CPLD", "DPGC", "DPGN", "ICM", "POAH"]
COMMUNITY_PSYCHIATRIC = ["CSAC", "DPPC", "DPPN", "PGER", "PPSY", "PSY", "SPSY", "STUC"]
COMMUNITY_ALLIED = ["OT", "PT", "DHOT", "DHPT", "VITO", "VITP", "VOS"]
SERVICE_PRICES = {
    "pdh": 1260, "gdh": 1960, "rdh": 1320, "gopc": 445, "sopc_gen": 1190, "sopc_psy": 1190,
    "sopc_ah": 1190, "com_gen": 535, "com_psy": 1550, "com_ah": 1730, "injection": 100,
}
SERVICE_PATTERNS = {
    "pdh": "^AHPD$|^PDH$",
    "gdh": "^AHGD$|^GDH",
    "rdh": "^AHRD$|^RDP$|^RDPC$|^RDPN$|^RDPP$",
    "gopc": "^GOP$|^GOP IPC$|^NAHC|^RAMP|^Smoking",
    "gopc_specialty": "^GOAD$",
    "sopc_gen": "^FM$|^NUR|^SOP",
    "sopc_psy": "^NUR|^SOP",
    "sopc_ah": "^AHJ$|^AHOO$|^AHOP$|^AHTC$",
    "com_gen": "^CEOL$|^CGAT$|^CVMO$|^ICMD$|^ICMN$",
    "com_gen_excluded": "^VITO$|^VITP$|^VOS$|^DHOT$|^DHPT$",
    "com_psy": "^Community Psychiatric Services$|^PG Outreach$",
    "com_ah": "^AHC$|^ICMA$",
    "injection": "Dressing|Injection",
}
PSYCHIATRIC_CLASSES = ["sopc_psy", "pdh", "com_psy"]


def service_rules() -> dict[str, Column]:
    """Membership test of each outpatient class. A row may belong to several classes."""
    p = SERVICE_PATTERNS
    kind, group = F.col("service_type"), F.col("service_group")
    specialty, sub = F.col("specialty"), F.col("sub_specialty")
    psychiatric = F.col("eis_specialty") == "PSY"
    community = group == COMMUNITY
    rules = {
        "pdh": contains_pattern(kind, p["pdh"]),
        "gdh": contains_pattern(kind, p["gdh"]),
        "rdh": contains_pattern(kind, p["rdh"]),
        "gopc": any_rule(contains_pattern(group, p["gopc"]), contains_pattern(specialty, p["gopc_specialty"]))
        & excludes_pattern(group, p["injection"]),
        "sopc_gen": contains_pattern(group, p["sopc_gen"]) & ~psychiatric,
        "sopc_psy": contains_pattern(group, p["sopc_psy"]) & psychiatric,
        "sopc_ah": contains_pattern(kind, p["sopc_ah"]),
        "com_gen": any_rule(contains_pattern(kind, p["com_gen"]), community & specialty.isin(COMMUNITY_GENERAL))
        & excludes_pattern(sub, p["com_gen_excluded"]),
        "com_psy": any_rule(contains_pattern(group, p["com_psy"]), community & specialty.isin(COMMUNITY_PSYCHIATRIC)),
        "com_ah": any_rule(contains_pattern(kind, p["com_ah"]), community & sub.isin(COMMUNITY_ALLIED)),
        "injection": contains_pattern(group, p["injection"]),
    }
    return {name: replace_null(rule, False) for name, rule in rules.items()}


def conditions_before_index(df: DataFrame) -> DataFrame:
    """Condition flags strictly before the index date; ``comorbid`` = gained since baseline."""
    flagged = condition_flags(df, F.col("index_date"), ("before_somatic", "before_mental", "before_any"))
    return flagged.withColumn("comorbid", (F.col("before_any") > F.col("baseline_any")).cast("int"))


def new_condition_after_index(df: DataFrame) -> DataFrame:
    """1 if a condition is first recorded from the index date to the end of follow-up."""
    found = F.exists("history", lambda c: c["event_date"].between(F.col("index_date"), F.col("follow_up_end")))
    return df.withColumn("new_condition", found.cast("int"))


def _of_cohort(records: DataFrame, master: DataFrame) -> DataFrame:
    """Records of the entities of ``master``, cut before they are folded."""
    return records.join(master.select("entity_id").distinct(), on="entity_id", how="left_semi")


def _window_of(master: DataFrame) -> DataFrame:
    return master.select("entity_id", "index_date", "follow_up_end")


def ed_cost(visits: DataFrame, master: DataFrame, price: float = ED_PRICE) -> DataFrame:
    """Distinct emergency records inside the window: ``ed_episodes`` and ``ed_cost`` per entity.

    Records are counted per (entity, day) before they meet the master, so an entity brings at most
    one row per day into the join.
    """
    per_day = _of_cohort(visits, master).distinct().groupBy("entity_id", "attend_date").agg(F.count(F.lit(1)).alias("_n"))
    inside = join_window(
        per_day, _window_of(master), "entity_id", "attend_date", F.col("index_date"), F.col("follow_up_end")
    )
    return inside.groupBy("entity_id").agg(F.sum("_n").alias("ed_episodes")).withColumn(
        "ed_cost", F.col("ed_episodes") * F.lit(price)
    )


def stay_cost(stays: DataFrame, master: DataFrame, tariffs: Mapping[str, float] = WARD_TARIFFS) -> DataFrame:
    """Ward days inside the window, prorated by day, and their price per entity.

    Columns: ``los_<ward>``, ``los_total``, ``ip_<ward>_cost`` and ``ip_cost``. One record counts
    per (entity, admission, discharge): the one whose ward-day texts sort first.
    """
    texts = ["los_acute", "los_convalescent", "los_high", "los_icu", "los_psy"]
    single = first_per_key(
        _of_cohort(stays.select("entity_id", "admit_date", "discharge_date", *texts), master),
        ["entity_id", "admit_date", "discharge_date"], texts,
    )
    # An entity may have any number of stays, so its rows are spread over the join.
    kept = join_window(
        single, _window_of(master), "entity_id", "discharge_date", F.col("index_date"), F.col("discharge_date"),
        salts=16,
    ).where(F.col("admit_date") <= F.col("follow_up_end"))
    days = {t: replace_null(parse_number(F.col(t)), 0.0) for t in texts}
    # Both ends count, so admission on the index date already lies one day before it.
    lead = clip_zero(inclusive_days(F.col("admit_date"), F.col("index_date")))
    lag = clip_zero(inclusive_days(F.col("follow_up_end"), F.col("discharge_date")))
    span = inclusive_days(F.col("admit_date"), F.col("discharge_date"))
    share = F.lit(1.0) - F.try_divide((lead + lag).cast("double"), span.cast("double"))
    wards = {
        "general": days["los_acute"] + days["los_convalescent"],
        "high": days["los_high"], "icu": days["los_icu"], "psy": days["los_psy"],
    }
    prorated = kept.select("entity_id", *[(v * share).alias(f"los_{w}") for w, v in wards.items()])
    summed = prorated.groupBy("entity_id").agg(*[F.sum(f"los_{w}").alias(f"los_{w}") for w in wards])
    total = sum((F.col(f"los_{w}") for w in wards), start=F.lit(0.0))
    costs = {f"ip_{w}_cost": F.col(f"los_{w}") * F.lit(float(tariffs[w])) for w in wards}
    return (
        summed.withColumn("los_total", total).withColumns(costs)
        .withColumn("ip_cost", sum((F.col(c) for c in costs), start=F.lit(0.0)))
    )


def outpatient_window(services: DataFrame, master: DataFrame) -> DataFrame:
    """Distinct outpatient rows inside the window."""
    return join_window(
        _of_cohort(services, master).distinct(), _window_of(master), "entity_id", "visit_date",
        F.col("index_date"), F.col("follow_up_end"),
    ).drop("index_date", "follow_up_end")


def classify_visits(
    services: DataFrame, master: DataFrame, classes: Sequence[str] | None = None,
    prices: Mapping[str, float] = SERVICE_PRICES,
) -> DataFrame:
    """``<class>_episodes`` and ``<class>_cost`` per entity, one episode per entity, day and class.

    One scan for all classes. Flags are folded per (entity, day) first, which also spreads an
    entity with very many rows, and only then joined to the window and summed.
    """
    rules = service_rules()
    classes = list(classes or rules)
    per_day = _of_cohort(services, master).groupBy("entity_id", "visit_date").agg(
        *[F.max(rules[c].cast("int")).alias(c) for c in classes]
    ).where(F.greatest(*[F.col(c) for c in classes], F.lit(0)) > 0)
    inside = join_window(
        per_day, _window_of(master), "entity_id", "visit_date", F.col("index_date"), F.col("follow_up_end")
    )
    counts = inside.groupBy("entity_id").agg(*[F.sum(c).alias(f"{c}_episodes") for c in classes])
    return counts.withColumns({f"{c}_cost": F.col(f"{c}_episodes") * F.lit(prices[c]) for c in classes})


def attach_costs(master: DataFrame, *parts: DataFrame) -> DataFrame:
    """Join per-entity utilisation frames to the master; an entity without any gets zeros."""
    for part in parts:
        master = left_fill(master, part, "entity_id", {c: 0 for c in part.columns if c != "entity_id"})
    return master


def total_cost(df: DataFrame, classes: Sequence[str] = tuple(SERVICE_PRICES)) -> DataFrame:
    """Outpatient totals and the overall cost."""
    episodes = sum((F.col(f"{c}_episodes") for c in classes), start=F.lit(0))
    op = sum((F.col(f"{c}_cost") for c in classes), start=F.lit(0))
    return (
        df.withColumn("op_episodes", episodes).withColumn("op_cost", op)
        .withColumn("overall_cost", F.col("ed_cost") + F.col("ip_cost") + F.col("op_cost"))
    )


def psych_cost(df: DataFrame, classes: Sequence[str] = tuple(PSYCHIATRIC_CLASSES)) -> DataFrame:
    op = sum((F.col(f"{c}_cost") for c in classes), start=F.lit(0))
    return df.withColumn("op_psy_cost", op).withColumn(
        "overall_psy_cost", F.col("ip_psy_cost") + F.col("op_psy_cost")
    )


def arm_summary(df: DataFrame, arm: str = "progressed", cost: str = "overall_cost") -> DataFrame:
    """Mean cost and mean cost per person-year by arm, over entities with follow-up."""
    rate = per_person_year(F.col(cost), F.col("follow_up_days"))
    return df.where(F.col("follow_up_days") > 0).groupBy(arm).agg(
        F.count(F.lit(1)).alias("n"), F.avg(rate).alias("mean_cost_py"), F.avg(cost).alias("mean_cost")
    )


RATE_COLUMNS = [
    "overall_cost", "ip_cost", "op_cost", "ed_cost", "ip_psy_cost", "op_psy_cost", "overall_psy_cost",
]


def cost_rates(df: DataFrame, columns: Sequence[str] = tuple(RATE_COLUMNS), min_days: int = 1) -> DataFrame:
    """Cost columns per person-year, for entities with at least ``min_days`` of follow-up.

    With ``min_days=0`` rows without follow-up stay and have null rates.
    """
    kept = df.where(F.col("follow_up_days") >= min_days)
    return kept.withColumns({f"{c}_py": per_person_year(F.col(c), F.col("follow_up_days")) for c in columns})


# Order of cost types, health states and care settings in the report.
TYPES = ["All-cause", "Psychiatric"]
STATES = ["NTRD", "TRD", "NTRD-comorbid", "TRD-comorbid"]
SETTINGS = ["Accident & Emergency", "Outpatient", "Inpatient", "Overall"]


def state_cost_table(rates: DataFrame, z: float = 1.96) -> DataFrame:
    """(type, state, setting, cost, cost_lower, cost_upper): mean cost per person-year and its interval.

    Psychiatric costs have no emergency part.
    """
    progressed, comorbid = F.col("progressed") == 1, F.col("new_condition") == 1
    state = (
        F.when(progressed & comorbid, STATES[3]).when(comorbid, STATES[2]).when(progressed, STATES[1])
        .otherwise(STATES[0])
    )
    columns = {
        TYPES[0]: dict(zip(SETTINGS, ["ed_cost_py", "op_cost_py", "ip_cost_py", "overall_cost_py"])),
        TYPES[1]: dict(zip(SETTINGS[1:], ["op_psy_cost_py", "ip_psy_cost_py", "overall_psy_cost_py"])),
    }
    cells = [(t, s, F.col(c)) for t, by_setting in columns.items() for s, c in by_setting.items()]
    means = rates.groupBy(state.alias("state")).agg(F.array(*[
        F.struct(F.lit(t).alias("type"), F.lit(s).alias("setting"), F.avg(c).alias("cost"),
                 (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("se"))
        for t, s, c in cells
    ]).alias("cells"))
    return means.select("state", F.inline("cells")).select(
        "type", "state", "setting", "cost",
        (F.col("cost") - F.lit(z) * F.col("se")).alias("cost_lower"),
        (F.col("cost") + F.lit(z) * F.col("se")).alias("cost_upper"),
    )


def stacked_summary(df: DataFrame, overall: bool) -> DataFrame:
    """Either the overall rows or the parts, in report order."""
    is_overall = F.col("setting") == SETTINGS[3]
    part = df.where(is_overall if overall else ~is_overall)
    return sort_by_levels(part, {"type": TYPES, "setting": SETTINGS, "state": STATES})


def ward_summary(df: DataFrame, decimals: int | None = None) -> DataFrame:
    wards = ["los_general", "los_psy", "los_high", "los_icu", "los_total"]
    return rate_summary(df, ["progressed"], wards, "follow_up_days", decimals)
