from datetime import date

import pytest
from pyspark.sql import functions as F

from lifeledger.operators import cost
from lifeledger.operators.tables import baseline_table, baseline_tests

D = date
INDEX, END = D(2016, 1, 10), D(2016, 1, 20)
STAY = (
    "entity_id int, admit_date date, discharge_date date, los_acute string, los_convalescent string, "
    "los_high string, los_icu string, los_psy string"
)


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([(1, INDEX, END)], "entity_id int, index_date date, follow_up_end date")


def general_days(spark, master, admit, discharge, days="10"):
    stays = spark.createDataFrame([(1, admit, discharge, days, None, None, None, None)], STAY)
    row = cost.stay_cost(stays, master).first()
    return None if row is None else row["los_general"]


@pytest.mark.parametrize("admit, discharge, share", [
    (D(2016, 1, 11), D(2016, 1, 19), 1.0),
    (D(2016, 1, 10), D(2016, 1, 19), 0.9),       # admitted on the index date: one day before it
    (D(2016, 1, 11), D(2016, 1, 20), 0.9),       # discharged on the end: one day after it
    (D(2016, 1, 6), D(2016, 1, 15), 0.5),        # lies across the index date
    (D(2016, 1, 15), D(2016, 1, 15), 1.0),       # one day
    (D(2016, 1, 1), D(2016, 1, 10), 0.0),
    (D(2016, 1, 1), D(2016, 1, 9), None),        # over before the window
    (D(2016, 1, 21), D(2016, 1, 22), None),
])
def test_stay_proration(spark, master, admit, discharge, share):
    got = general_days(spark, master, admit, discharge)
    assert got == (None if share is None else pytest.approx(10 * share))


def test_stay_texts_duplicates_and_prices(spark, master):
    a, b = D(2016, 1, 12), D(2016, 1, 14)
    stays = spark.createDataFrame([
        (1, a, b, "1", "2", None, "x", ""), (1, a, b, "9", "2", None, "x", ""),
        (1, D(2016, 1, 15), D(2016, 1, 16), None, None, "1", "2", "3"), (2, a, b, "5", None, None, None, None),
    ], STAY)
    r = cost.stay_cost(stays, master).collect()
    assert len(r) == 1
    assert (r[0]["los_general"], r[0]["los_high"], r[0]["los_icu"], r[0]["los_psy"], r[0]["los_total"]) == (3, 1, 2, 3, 9)
    assert r[0]["ip_cost"] == 3 * 5100 + 13650 + 2 * 24400 + 3 * 2340


def test_ed_counts_distinct_records_in_the_window(spark, master):
    visits = spark.createDataFrame([
        (1, INDEX, INDEX, "a"), (1, INDEX, INDEX, "a"), (1, INDEX, INDEX, "b"), (1, END, END, None),
        (1, D(2016, 1, 9), INDEX, "a"), (1, D(2016, 1, 21), END, "a"), (2, INDEX, INDEX, "a"),
    ], "entity_id int, attend_date date, discharge_date date, dx_1 string")
    r = cost.ed_cost(visits, master).collect()
    assert [(x["entity_id"], x["ed_episodes"], x["ed_cost"]) for x in r] == [(1, 3, 3 * 1230)]


SERVICE = (
    "entity_id int, visit_date date, service_type string, service_group string, specialty string, "
    "sub_specialty string, eis_specialty string"
)
GROUP = "C - Community Service"


@pytest.mark.parametrize("row, classes", [
    (("PDH", None, None, None, None), {"pdh"}),
    (("GDHX", None, None, None, None), {"gdh"}),
    (("RDPC", None, None, None, None), {"rdh"}),
    ((None, "Smoking Cessation", None, None, None), {"gopc"}),
    ((None, None, "GOAD", None, None), {"gopc"}),
    ((None, "RAMP Dressing", None, None, None), {"injection"}),
    ((None, "NUR", None, None, "MED"), {"sopc_gen"}),
    ((None, "NUR", None, None, None), set()),
    ((None, "SOP", None, None, "PSY"), {"sopc_psy"}),
    ((None, "FM", None, None, "PSY"), set()),
    (("AHTC", None, None, None, None), {"sopc_ah"}),
    ((None, GROUP, "DH", None, None), {"com_gen"}),
    ((None, GROUP, "DH", "VITO", None), {"com_ah"}),
    (("CGAT", GROUP, "PSY", "PT", None), {"com_gen", "com_psy", "com_ah"}),
    ((None, "PG Outreach", None, None, None), {"com_psy"}),
    (("ICMA", None, None, None, None), {"com_ah"}),
    ((None, "xx Injection", None, None, None), {"injection"}),
    (("OTHER", "Other", "MED", "GEN", "MED"), set()),
])
def test_service_rules(spark, row, classes):
    df = spark.createDataFrame([(1, INDEX, *row)], SERVICE)
    got = df.select(*[r.alias(n) for n, r in cost.service_rules().items()]).first().asDict()
    assert {n for n, hit in got.items() if hit} == classes


def test_one_episode_per_day_and_class(spark, master):
    rows = [(1, INDEX, "PDH", None, None, None, None), (1, INDEX, "AHPD", None, None, None, None),
            (1, END, "PDH", "xx Injection", None, None, None), (1, D(2016, 2, 1), "PDH", None, None, None, None)]
    r = cost.classify_visits(spark.createDataFrame(rows, SERVICE), master).first()
    assert (r["pdh_episodes"], r["pdh_cost"], r["injection_episodes"], r["gdh_episodes"]) == (2, 2520, 1, 0)


def test_zero_follow_up_has_no_rate(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 1461, 8.0), (3, -4, 1.0)], "entity_id int, follow_up_days int, overall_cost double")
    assert [(r["entity_id"], r["overall_cost_py"]) for r in cost.cost_rates(df, ["overall_cost"]).collect()] == [(2, 2.0)]
    assert {r["entity_id"]: r["overall_cost_py"] for r in cost.cost_rates(df, ["overall_cost"], min_days=0).collect()} == {1: None, 2: 2.0}


def test_baseline_table_and_tests(spark):
    rows = [(0, 1.0, "a"), (0, 2.0, "a"), (0, 3.0, "b"), (1, 2.0, "b"), (1, 4.0, "b"), (1, 6.0, "a"), (1, 8.0, "b")]
    df = spark.createDataFrame(rows, "arm int, x double, c string")
    out = {(r["variable"], r["level"]): r for r in baseline_table(df, "arm", ["x"], {"c": ["a", "b"]}).collect()}
    x, a = out[("x", None)], out[("c", "a")]
    assert (x["n_0"], x["n_1"], x["mean_0"], x["mean_1"]) == (3, 4, 2.0, 5.0)
    assert x["smd"] == pytest.approx(3 / ((1 + 20 / 3) / 2) ** 0.5)
    assert (a["count_0"], a["count_1"]) == (2, 1)
    tests = {r["variable"]: r for r in baseline_tests(df, "arm", ["x"], {"c": ["a", "b"]}).collect()}
    # Known values: pooled t = 3 / sqrt(22/5 * 7/12) with 5 degrees of freedom.
    assert tests["x"]["statistic"] == pytest.approx(1.872563352)
    assert tests["x"]["p"] == pytest.approx(0.1201, abs=2e-4)
    assert 0 < tests["c"]["p"] <= 1


def test_chi_squared_tail(spark):
    from lifeledger.operators.tables import _chi_sf

    df = spark.createDataFrame([(5.0,)], "x double")
    got = df.select(*[_chi_sf(F.col("x"), k).alias(str(k)) for k in (1, 2, 3, 4, 5)]).first()
    assert list(got) == pytest.approx([0.0253473, 0.0820850, 0.1717971, 0.2872975, 0.4158802], abs=1e-6)


def test_state_costs_follow_block_order_and_refuse_gaps(spark):
    from lifeledger.sources import load_state_costs

    rows = [(i, float(i)) for i in range(8)]
    got = {(r["state"], r["subgroup"]): r["cost"]
           for r in load_state_costs(spark.createDataFrame(rows, "position int, cost double"), 2).collect()}
    assert len(got) == 12
    assert [got[s, 0] for s in range(6)] == [0.0, 4.0, 2.0, 6.0, 0.0, 0.0]
    assert [got[s, 1] for s in range(6)] == [1.0, 5.0, 3.0, 7.0, 0.0, 0.0]
    for bad in (rows[1:], [*rows, (3, 9.0)], [*rows, (8, 1.0)], [*rows, (None, 1.0)], [*rows[1:], (0, None)]):
        with pytest.raises(Exception, match="missing, doubled or out of range"):
            load_state_costs(spark.createDataFrame(bad, "position int, cost double"), 2).collect()


def test_state_costs_have_both_types(spark):
    rates = spark.createDataFrame(
        [(0, 0, 1.0, 2.0, 3.0, 6.0, 0.5, 0.25, 0.75), (0, 0, 3.0, 4.0, 5.0, 12.0, 1.5, 0.75, 2.25)],
        "progressed int, new_condition int, ed_cost_py double, op_cost_py double, ip_cost_py double, "
        "overall_cost_py double, op_psy_cost_py double, ip_psy_cost_py double, overall_psy_cost_py double",
    )
    table = cost.state_cost_table(rates)
    parts = [(r["type"], r["setting"], r["cost"]) for r in cost.stacked_summary(table, overall=False).collect()]
    assert parts == [
        ("All-cause", "Accident & Emergency", 2.0), ("All-cause", "Outpatient", 3.0), ("All-cause", "Inpatient", 4.0),
        ("Psychiatric", "Outpatient", 1.0), ("Psychiatric", "Inpatient", 0.5),
    ]
    whole = {r["type"]: r["cost"] for r in cost.stacked_summary(table, overall=True).collect()}
    assert whole == {"All-cause": 9.0, "Psychiatric": 1.5}
