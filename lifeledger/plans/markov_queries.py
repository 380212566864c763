"""Markov projection with parameters counted from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.operators import markov
from lifeledger.plans.registry import query
from lifeledger.plans.roles import Tables
from lifeledger.sources import load_markov_params

_AMOUNT = "round(cost, 4) AS cost"


def _params(t: Tables) -> DataFrame:
    return load_markov_params(t.probability_blocks)


def _occupancy(t: Tables) -> DataFrame:
    return markov.markov_project(markov.start(t.incidence, t.weights), _params(t))


def _costs(t: Tables) -> DataFrame:
    return markov.state_cost(_occupancy(t), t.state_costs)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", F.round("cost", 4))


@query("SELECT cohort, subgroup, round(s0, 6) AS s0, s1 + s2 + s3 + s4 + s5 AS others FROM k_start")
def start_state(t: Tables) -> DataFrame:
    starts = markov.start(t.incidence, t.weights)
    rest = F.aggregate(F.slice("state", 2, 5), F.lit(0.0), lambda a, x: a + x)
    return starts.select("cohort", "subgroup", F.round(F.col("state")[0], 6).alias("s0"), rest.alias("others"))


@query("SELECT cohort, subgroup, " + ", ".join(f"round(s{i}, 6) AS s{i}" for i in range(6)) + " FROM k_path WHERE t = 1")
def markov_step(t: Tables) -> DataFrame:
    first = markov.cycles(_params(t)).select("subgroup", F.col("cycles")[0]["p"].alias("p"))
    moved = markov.start(t.incidence, t.weights).join(first, on="subgroup").select(
        "cohort", "subgroup", markov.step(F.col("state"), F.col("p")).alias("s"))
    return moved.select("cohort", "subgroup", *[F.round(F.col("s")[i], 6).alias(f"s{i}") for i in range(6)])


@query("SELECT cohort, subgroup, t, state, round(occupancy, 6) AS occupancy FROM k_occupancy")
def markov_project(t: Tables) -> DataFrame:
    return _occupancy(t).withColumn("occupancy", F.round("occupancy", 6))


@query(f"SELECT cohort, subgroup, t, {_AMOUNT} FROM k_cost")
def state_cost(t: Tables) -> DataFrame:
    return _rounded(_costs(t))


@query(f"SELECT cohort, t, {_AMOUNT} FROM k_cohort_cost")
def cohort_cost(t: Tables) -> DataFrame:
    return _rounded(markov.cohort_cost(_costs(t)))


@query(f"SELECT cohort, subgroup, t, {_AMOUNT} FROM k_cost WHERE subgroup = 1 AND t >= 1")
def subgroup_cost(t: Tables) -> DataFrame:
    return _rounded(markov.subgroup_cost(_costs(t), 1))


@query("""SELECT CAST(cohort + t - 1 AS INTEGER) AS year, round(sum(cost), 4) AS cost, count(*) AS n_cohorts
          FROM k_cohort_cost GROUP BY 1""")
def open_cohort_cost(t: Tables) -> DataFrame:
    return _rounded(markov.open_cohort_cost(markov.cohort_cost(_costs(t))))
