import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifeledger.operators import matching


def greedy(cases, controls, ratio, width):
    """Plain sequential matching on scores; returns sorted (case score, turn, control score)."""
    free, out = sorted(controls, reverse=True), []
    for turn in range(1, ratio + 1):
        for s in sorted(cases, reverse=True):
            best = min(free, key=lambda c: (abs(c - s), -c), default=None)
            if best is not None and abs(best - s) <= width:
                free.remove(best)
                out.append((s, turn, best))
    return sorted(out)


@pytest.mark.parametrize("seed, levels, block", [(1, 8, 50_000), (3, 10_000, 50_000), (1, 8, 4), (2, 40, 25), (3, 10_000, 60), (4, 10_000, 15)])
def test_equals_sequential_greedy(spark, seed, levels, block):
    rng = random.Random(seed)
    rows, want = [], []
    for cohort in (2014, 2015, 2016):
        scores = {a: [rng.randrange(levels) / levels for _ in range(n)] for a, n in ((1, 25), (0, 70))}
        width = 0.25 * float(np.std(scores[1] + scores[0], ddof=1))
        want += [(cohort, *m) for m in greedy(scores[1], scores[0], 4, width)]
        rows += [(len(rows) + i, cohort, a, s) for i, (a, s) in enumerate((a, s) for a in (1, 0) for s in scores[a])]
    df = spark.createDataFrame(rows, "id long, cohort int, arm int, score double")
    out = matching.match_nearest(df, "id", "arm", "score", "cohort", block_size=block).collect()
    score = {r[0]: r[3] for r in rows}
    got = sorted((r["cohort"], score[r["subclass"]], r["match_no"], r["score"]) for r in out if r["match_no"] > 0)
    assert got == sorted(want)
    # Every row is used once, every subclass holds its own case and nothing from another cohort.
    assert len({r["id"] for r in out}) == len(out)
    cases = {r["id"]: r["cohort"] for r in out if r["arm"] == 1}
    assert all(r["subclass"] in cases and cases[r["subclass"]] == r["cohort"] for r in out)
    # Controls of a case share its weight; in each cohort their weights sum to their number.
    assert all(r["weight"] == 1 for r in out if r["match_no"] == 0)
    for cohort in (2014, 2015, 2016):
        used = [r for r in out if r["match_no"] > 0 and r["cohort"] == cohort]
        shared = {}
        for r in used:
            shared[r["subclass"]] = shared.get(r["subclass"], 0) + r["weight"]
        assert max(shared.values()) == pytest.approx(min(shared.values()))
        assert sum(shared.values()) == pytest.approx(len(used))


def test_nothing_in_caliper_is_left_out(spark):
    rows = [(1, 1, 1, 0.9), (2, 1, 1, 0.1), (3, 1, 0, 0.1), (4, 1, 0, 0.1), (5, 1, 0, 0.12)]
    df = spark.createDataFrame(rows, "id int, cohort int, arm int, score double")
    out = matching.match_nearest(df, "id", "arm", "score", "cohort", caliper=0.2).collect()
    assert {r["id"] for r in out} == {2, 3, 4, 5}
    assert {r["subclass"] for r in out} == {2}


def crowded(n_cases, n_controls):
    """All cases above all controls, so that every case asks for the same controls."""
    return [2.0 + i / 1000 for i in range(n_cases)], [1.0 + i / 1000 for i in range(n_controls)]


@pytest.mark.parametrize("block", [7, 20, 50_000])
def test_cases_that_all_ask_for_the_same_controls(spark, block):
    cases, controls = crowded(30, 80)
    rows = [(i, 1, a, s) for i, (a, s) in enumerate([(1, s) for s in cases] + [(0, s) for s in controls])]
    df = spark.createDataFrame(rows, "id long, cohort int, arm int, score double")
    out = matching.match_nearest(df, "id", "arm", "score", "cohort", caliper=2.2, block_size=block).collect()
    score = {r[0]: r[3] for r in rows}
    got = sorted((score[r["subclass"]], r["match_no"], r["score"]) for r in out if r["match_no"] > 0)
    width = 2.2 * float(np.std(cases + controls, ddof=1))
    assert got == greedy(cases, controls, 4, width) and len(got) == 40


def test_rows_without_a_score_or_a_second_row_are_left_out(spark):
    rows = [(1, 1, 1, 0.5), (2, 1, 0, 0.5), (3, 1, 0, None), (4, 2, 1, 0.5), (5, None, 1, 0.5)]
    df = spark.createDataFrame(rows, "id int, cohort int, arm int, score double")
    assert {r["id"] for r in matching.match_nearest(df, "id", "arm", "score", "cohort").collect()} == {1, 2}
    assert matching.match_nearest(df.limit(0), "id", "arm", "score", "cohort").count() == 0


def test_no_task_sees_a_cohort():
    import inspect

    text = inspect.getsource(matching)
    assert "pyspark.ml" not in text and text.count("applyInPandas") == 1 and 'groupBy(by, "asker").applyInPandas' in text


def test_scores_of_all_groups_equal_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):
        age, sex, noise = rng.integers(12, 80, 900), rng.integers(0, 2, 900), rng.normal(size=900)
        p = 1 / (1 + np.exp(-(-2 + 0.02 * (g + 1) * age + 0.5 * sex)))
        arm = (rng.random(900) < p).astype(int)
        rows += [(len(rows) + i, g, int(a), float(z), "M" if s else "F", int(y)) for i, (a, z, s, y) in enumerate(zip(age, noise, sex, arm))]
    df = spark.createDataFrame(rows, "id int, cohort int, age int, noise double, sex string, arm int")
    got = {r["id"]: r["ps"] for r in matching.propensity(df, "arm", ["age", "noise"], {"sex": "M"}, "cohort").collect()}
    for g in range(3):
        own = df.where(F.col("cohort") == g).withColumn("male", (F.col("sex") == "M").cast("int"))
        own = VectorAssembler(inputCols=["age", "noise", "male"], outputCol="features").transform(own)
        model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="arm", maxIter=100, tol=1e-14).fit(own)
        assert all(abs(got[r["id"]] - r["prediction"]) < 1e-8 for r in model.transform(own).collect())


def test_a_separated_group_ends(spark):
    rows = [(i, 1 + i % 2, i, int(i > 10) if i % 2 else 0) for i in range(20)] + [(99, None, 3, 1)]
    df = spark.createDataFrame(rows, "id int, cohort int, age int, arm int")
    got = {r["id"]: r["ps"] for r in matching.propensity(df, "arm", ["age"], {}, "cohort").collect()}
    assert got[99] is None and all(got[i] < 0.02 for i in range(0, 20, 2)) and got[1] < 0.02 and got[19] > 0.98


def test_logistic_score(spark):
    rng = np.random.default_rng(0)
    n = 4000
    age, sex = rng.integers(12, 80, n), rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(-2 + 0.03 * age + 0.5 * sex)))
    arm = (rng.random(n) < p).astype(int)
    df = spark.createDataFrame(
        [(i, 1, int(a), "M" if s else "F", int(y)) for i, (a, s, y) in enumerate(zip(age, sex, arm))],
        "id int, cohort int, age int, sex string, arm int")
    got = matching.propensity(df, "arm", ["age"], {"sex": "M"}, "cohort").orderBy("id").toPandas()["ps"].to_numpy()
    # The score equations of a logistic fit: residuals are orthogonal to every covariate.
    for x in (np.ones(n), age, sex):
        assert abs(((arm - got) * x).sum()) < 1e-4 * n
    assert np.abs(got - p).max() < 0.08


def test_shared_date_is_not_before_entry(spark):
    D = date
    rows = [(1, 2014, 1, 1, D(2014, 2, 1), D(2015, 1, 1)), (2, 2014, 1, 0, D(2014, 3, 1), None),
            (3, 2014, 1, 0, D(2015, 6, 1), D(2016, 1, 1)), (4, 2014, 2, 0, D(2014, 3, 1), None)]
    df = spark.createDataFrame(rows, "entity_id int, cohort_year int, subclass int, progressed int, entry_date date, progression_date date")
    out = matching.share_case_date(df).orderBy("entity_id").collect()
    assert [r["progression_date"] for r in out][:3] == [D(2015, 1, 1), D(2015, 1, 1), D(2015, 6, 1)]
    stacked = matching.stack_cohorts([df.withColumn("follow_up_end", F.lit(D(2015, 1, 1)))])
    days = {r["entity_id"]: r["follow_up_days"] for r in stacked.collect()}
    assert days[1] == 1 and days[3] < 0


def test_strata_keep_every_case_and_use_a_control_once(spark):
    rows = [(i, 1, "F", 1) for i in range(3)] + [(10 + i, 1, "F", 0) for i in range(20)]
    rows += [(40 + i, 1, "M", 1) for i in range(4)] + [(50 + i, 1, "M", 0) for i in range(6)]
    rows += [(60, 2, "F", 1), (61, 2, "M", 0)]
    df = spark.createDataFrame(rows, "id int, year int, sex string, arm int")
    out = matching.match_strata(df, "id", "arm", ["year", "sex"]).collect()
    stratum = {r[0]: r[1:3] for r in rows}
    assert len({r["id"] for r in out}) == len(out)
    assert {r["id"] for r in out if r["arm"] == 1} == {0, 1, 2, 40, 41, 42, 43, 60}
    assert all(stratum[r["id"]] == stratum[r["subclass"]] for r in out)
    taken = {c: sorted(r["match_no"] for r in out if r["subclass"] == c) for c in {r["subclass"] for r in out}}
    assert all(taken[c] == [0, 1, 2, 3, 4] for c in (0, 1, 2)) and taken[60] == [0]
    # Six controls for four cases: everybody gets one before anybody gets a second.
    assert sorted(len(taken[c]) for c in (40, 41, 42, 43)) == [2, 2, 3, 3]


def test_strata_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, year int, arm int")
    assert matching.match_strata(df, "id", "arm", ["year"]).count() == 0
