import numpy as np
import pytest
from pyspark.sql import functions as F

from lifeledger.operators import markov


def params(spark, subgroups, period, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subgroups):
        for t in range(period):
            p = rng.random(16)
            for targets in markov.TRANSITIONS.values():
                ix = list(targets.values())
                p[ix] /= p[ix].sum()
            rows += [(s, t, i, float(v)) for i, v in enumerate(p)]
    return spark.createDataFrame(rows, "subgroup int, t int, ix int, p double"), rows


def matrix(p):
    place = {s: i for i, s in enumerate(markov.STATES)}
    m = np.zeros((6, 6))
    for a, targets in markov.TRANSITIONS.items():
        for b, i in targets.items():
            m[place[a], place[b]] = p[i]
    m[4, 4] = m[5, 5] = 1
    return m


def test_layout_has_every_index_once():
    used = sorted(i for targets in markov.TRANSITIONS.values() for i in targets.values())
    assert used == list(range(16))
    assert "TRD-c" not in markov.TRANSITIONS["NTRD-c"] and markov.TRANSITIONS["NTRD-c"]["TRD"] == 9


def test_projection_equals_matrix_products(spark):
    probabilities, rows = params(spark, 2, 3)
    cohorts = spark.createDataFrame([(2014, 100), (2015, 50)], "cohort int, incidence int")
    weights = spark.createDataFrame([(0, 0.25), (1, 0.75)], "subgroup int, weight double")
    starts = markov.start(cohorts, weights)
    got = {(r["cohort"], r["subgroup"], r["t"], r["state"]): r["occupancy"] for r in markov.markov_project(starts, probabilities, 3).collect()}
    assert len(got) == 2 * 2 * 4 * 6
    for cohort, n in ((2014, 100), (2015, 50)):
        for s, w in ((0, 0.25), (1, 0.75)):
            state = np.array([n * w, 0, 0, 0, 0, 0])
            for t in range(4):
                assert [got[(cohort, s, t, k)] for k in markov.STATES] == pytest.approx(list(state))
                assert state.sum() == pytest.approx(n * w)
                if t < 3:
                    state = state @ matrix([r[3] for r in rows if r[0] == s and r[1] == t])


@pytest.mark.parametrize("change, message", [
    (lambda rows: [r for r in rows if r[0] != 1], "subgroup 1, t 0, ix 0 is missing"),
    (lambda rows: [r for r in rows if r[:2] != (1, 2)], "t 2, ix 0 is missing"),
    (lambda rows: [r for r in rows if r[:3] != (0, 1, 5)], "t 1, ix 5 is missing"),
    (lambda rows: [*rows, (0, 1, 5, 0.1)], "t 1, ix 5 is given more than once"),
    (lambda rows: [*rows, (0, 1, 16, 0.1)], "ix 16 is out of range"),
    (lambda rows: [*rows, (0, -1, 3, 0.1)], "t -1, ix 3 is out of range"),
    (lambda rows: [r if r[:3] != (0, 1, 5) else (*r[:3], None) for r in rows], "t 1, ix 5 is missing"),
])
def test_probabilities_must_be_complete(spark, change, message):
    _, rows = params(spark, 2, 3)
    changed = spark.createDataFrame(change(rows), "subgroup int, t int, ix int, p double")
    starts = markov.start(spark.createDataFrame([(2014, 100)], "cohort int, incidence int"),
                          spark.createDataFrame([(0, 0.5), (1, 0.5)], "subgroup int, weight double"))
    with pytest.raises(Exception, match=message):
        markov.markov_project(starts, changed, 3).collect()


def test_rows_that_are_not_asked_for_do_no_harm(spark):
    probabilities, rows = params(spark, 3, 5)
    starts = markov.start(spark.createDataFrame([(2014, 100)], "cohort int, incidence int"),
                          spark.createDataFrame([(0, 1.0)], "subgroup int, weight double"))
    assert markov.markov_project(starts, probabilities, 3).count() == 4 * 6


@pytest.mark.parametrize("change, message", [
    (lambda rows: rows[1:], "is missing"), (lambda rows: [*rows, rows[0]], "more than once"),
    (lambda rows: [(rows[0][0], rows[0][1], None), *rows[1:]], "is missing"),
])
def test_costs_of_living_states_must_be_complete(spark, change, message):
    occupancy = spark.createDataFrame(
        [(1, 0, 0, s, 2.0) for s in markov.STATES], "cohort int, subgroup int, t int, state string, occupancy double")
    prices = change([(s, 0, 10.0) for s in markov.STATES[:4]])
    with pytest.raises(Exception, match=message):
        markov.state_cost(occupancy, spark.createDataFrame(prices, "state string, subgroup int, cost double")).collect()


def test_open_cohort_takes_the_diagonal(spark):
    by_cohort = spark.createDataFrame([(c, t, float(100 * c + t)) for c in (1, 2, 3) for t in (1, 2, 3)], "cohort int, t int, cost double")
    out = {r["year"]: (r["cost"], r["n_cohorts"]) for r in markov.open_cohort_cost(by_cohort).collect()}
    assert out[3] == (103 + 202 + 301, 3)
    assert out[1] == (101, 1) and out[5] == (303, 1)
    assert [r["year"] for r in markov.open_cohort_cost(by_cohort, (3, 3)).collect()] == [3]


def test_absorbing_states_cost_nothing(spark):
    rows = [(1, 0, t, s, 2.0) for t in (0, 1) for s in markov.STATES]
    occupancy = spark.createDataFrame(rows, "cohort int, subgroup int, t int, state string, occupancy double")
    prices = spark.createDataFrame([(s, 0, 10.0) for s in markov.STATES[:4]], "state string, subgroup int, cost double")
    costs = markov.state_cost(occupancy, prices)
    assert {r["t"]: r["cost"] for r in costs.collect()} == {0: 80.0, 1: 80.0}
    assert markov.cohort_cost(costs).agg(F.sum("cost")).first()[0] == 80.0
    assert markov.subgroup_cost(costs, 0).count() == 1
