"""Six-state Markov cohort projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.operators.relational import cross_param

# States, and for each (from, to) the index of its probability in a cycle's list.
STATES = ["NTRD", "NTRD-c", "TRD", "TRD-c", "DEAD", "LISU"]
TRANSITIONS = {
    "NTRD": {"NTRD": 4, "NTRD-c": 1, "TRD": 0, "DEAD": 2, "LISU": 3},
    "NTRD-c": {"NTRD-c": 12, "TRD": 9, "DEAD": 10, "LISU": 11},
    "TRD": {"TRD": 8, "TRD-c": 5, "DEAD": 6, "LISU": 7},
    "TRD-c": {"TRD-c": 15, "DEAD": 13, "LISU": 14},
}
ABSORBING = ["DEAD", "LISU"]
N_PROBABILITIES = 16
PERIOD = 10


def start(cohorts: DataFrame, weights: DataFrame) -> DataFrame:
    """(cohort, subgroup, state array at t = 0): everybody starts in the first state."""
    pairs = cross_param(cohorts, weights)
    first = F.col("incidence").cast("double") * F.col("weight")
    rest = [F.lit(0.0)] * (len(STATES) - 1)
    return pairs.select("cohort", "subgroup", F.array(first, *rest).alias("state"))


def step(state: Column, p: Column) -> Column:
    """State array after one cycle with that cycle's list of probabilities."""
    place = {name: i for i, name in enumerate(STATES)}
    arriving = []
    for target in STATES:
        inflow = [
            state[place[source]] * p[targets[target]] for source, targets in TRANSITIONS.items() if target in targets
        ]
        if target in ABSORBING:
            inflow.append(state[place[target]])
        total = inflow[0]
        for term in inflow[1:]:
            total = total + term
        arriving.append(total)
    return F.array(*arriving)


def checked(df: DataFrame, grid: DataFrame, keys: Sequence[str], value: str, what: str) -> DataFrame:
    """``df`` with one row for each key of ``grid``; an error names a key that is missing, doubled, null or not in the grid."""
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value))
    both = grid.select(*keys).distinct().withColumn("_wanted", F.lit(True)).join(found, on=list(keys), how="full")
    fault = (
        F.when(F.col("_wanted").isNull(), "is out of range")
        .when(F.col("_n").isNull() | F.col(value).isNull(), "is missing")
        .when(F.col("_n") > 1, "is given more than once")
    )
    error = F.raise_error(F.concat(F.lit(f"{what} of "), name, F.lit(" "), fault)).cast("double")
    return both.select(*keys, F.when(fault.isNotNull(), error).otherwise(F.col(value)).alias(value))


def _numbers(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(column))


def cycles(params: DataFrame, period: int = PERIOD, subgroups: DataFrame | None = None) -> DataFrame:
    """(subgroup, probabilities of all cycles in order) from rows (subgroup, t, ix, p).

    The rows must be one for each subgroup, cycle and place in the list; ``subgroups`` names those that are asked for,
    else every subgroup that has a row. Cycles at or beyond ``period`` are not part of the projection.
    """
    used = params.where(F.col("t").isNull() | (F.col("t") < period))
    groups = (params if subgroups is None else subgroups).select("subgroup").distinct()
    if subgroups is not None:
        used = used.join(groups, on="subgroup", how="left_semi")
    count = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    grid = _numbers(_numbers(groups, count(period), "t"), count(N_PROBABILITIES), "ix")
    whole = checked(used.select("subgroup", "t", "ix", "p"), grid, ["subgroup", "t", "ix"], "p", "transition probability")
    # 16 entries per cycle, and at most ``period`` entries per subgroup.
    per_cycle = whole.groupBy("subgroup", "t").agg(F.sort_array(F.collect_list(F.struct("ix", "p"))).alias("p"))
    packed = per_cycle.select("subgroup", F.struct("t", F.transform("p", lambda x: x["p"]).alias("p")).alias("cycle"))
    return packed.groupBy("subgroup").agg(F.sort_array(F.collect_list("cycle")).alias("cycles"))


def markov_project(starts: DataFrame, params: DataFrame, period: int = PERIOD) -> DataFrame:
    """Rows (cohort, subgroup, t, state, occupancy) for t = 0 ... period.

    A subgroup of the cohorts without a full set of probabilities is an error.
    """
    joined = starts.join(cycles(params, period, starts), on="subgroup", how="left")
    steps = F.coalesce("cycles", F.raise_error(F.lit("a subgroup has no transition probabilities")).cast(
        "array<struct<t:int,p:array<double>>>"
    ))
    path = F.aggregate(
        steps, F.array("state"), lambda acc, c: F.concat(acc, F.array(step(F.element_at(acc, -1), c["p"])))
    )
    by_cycle = joined.select("cohort", "subgroup", F.posexplode(path).alias("t", "occupancy"))
    named = F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]), F.col("occupancy"))
    return by_cycle.select("cohort", "subgroup", "t", F.explode(named).alias("state", "occupancy"))


def state_cost(occupancy: DataFrame, costs: DataFrame) -> DataFrame:
    """(cohort, subgroup, t, cost): occupancy times the cost of each state; absorbing states cost nothing.

    Each living state of each subgroup needs one cost; a missing or doubled one is an error.
    """
    living = [s for s in STATES if s not in ABSORBING]
    groups = occupancy.select("subgroup").distinct()
    grid = _numbers(groups, F.array(*[F.lit(s) for s in living]), "state")
    # Costs of subgroups that do not occur, and of absorbing states, are not asked for.
    asked = costs.where(F.col("state").isin(living)).join(groups, on="subgroup", how="left_semi")
    known = checked(asked.select("subgroup", "state", F.col("cost").cast("double").alias("cost")), grid, ["subgroup", "state"], "cost", "cost")
    priced = occupancy.where(F.col("state").isin(living)).join(known, on=["subgroup", "state"])
    return priced.groupBy("cohort", "subgroup", "t").agg(F.sum(F.col("occupancy") * F.col("cost")).alias("cost"))


def cohort_cost(costs: DataFrame) -> DataFrame:
    return costs.where(F.col("t") >= 1).groupBy("cohort", "t").agg(F.sum("cost").alias("cost"))


def subgroup_cost(costs: DataFrame, subgroup: int) -> DataFrame:
    return costs.where((F.col("subgroup") == subgroup) & (F.col("t") >= 1))


def open_cohort_cost(by_cohort: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Total per calendar year: cohort c spends its cycle t in year c + t - 1."""
    dated = by_cohort.withColumn("year", F.col("cohort") + F.col("t") - 1)
    if years:
        dated = dated.where(F.col("year").between(*years))
    return dated.groupBy("year").agg(F.sum("cost").alias("cost"), F.count("cohort").alias("n_cohorts"))
