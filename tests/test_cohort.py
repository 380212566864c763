from datetime import date

import pytest
from pyspark.sql import functions as F

from lifeledger.operators import cohort
from lifeledger.operators.cohort import DEFAULT_DATES

D = date
FUTURE = DEFAULT_DATES.far_future


def reconciled(spark, **case):
    base = dict(
        entity_id=1, entry_date=D(2015, 1, 1), death_date=None, death=0, natural_death=0, external_death=0,
        recovered_op=1, recovered_ae=1, recovered_ip=1, recovered_rx=1,
        recovery_op=None, recovery_ae=None, recovery_ip=None, recovery_rx=None,
    )
    base.update(case)
    schema = ", ".join(
        f"{k} {'date' if k.endswith('date') or k.startswith('recovery_') else 'int'}" for k in base
    )
    return cohort.reconcile(spark.createDataFrame([tuple(base.values())], schema), DEFAULT_DATES).first()


def test_recovered_without_any_date_gets_the_grace_period(spark):
    r = reconciled(spark)
    assert (r["recovered"], r["recovery_date"]) == (1, D(2015, 6, 30))


def test_latest_source_counts(spark):
    r = reconciled(spark, recovery_op=D(2016, 5, 1), recovery_rx=D(2017, 2, 1), recovery_ip=D(2016, 9, 9))
    assert (r["recovered"], r["adj_recovery_date"]) == (1, D(2017, 2, 1))


def test_one_active_source_is_enough_to_stay(spark):
    r = reconciled(spark, recovered_rx=0, recovery_op=D(2016, 5, 1))
    assert (r["recovered"], r["adj_recovery_date"]) == (0, FUTURE)
    # The date of the quiet source is kept all the same.
    assert r["recovery_date"] == D(2016, 5, 1)


def test_recovery_after_the_cutoff_is_none(spark):
    r = reconciled(spark, recovery_op=D(2021, 3, 1))
    assert (r["recovered"], r["recovery_date"], r["adj_recovery_date"]) == (0, None, FUTURE)


def test_early_recovery_is_moved_to_the_grace_period(spark):
    r = reconciled(spark, recovery_op=D(2015, 2, 1))
    assert r["recovery_date"] == D(2015, 6, 30)


def test_recovery_before_death_cancels_the_death(spark):
    r = reconciled(spark, recovery_op=D(2016, 1, 1), death_date=D(2018, 1, 1), death=1, natural_death=1)
    assert (r["recovered"], r["death"], r["natural_death"], r["adj_death_date"]) == (1, 0, 0, FUTURE)
    assert r["death_date"] == D(2018, 1, 1)


def test_death_before_recovery_cancels_the_recovery(spark):
    r = reconciled(spark, recovery_op=D(2018, 1, 1), death_date=D(2016, 1, 1), death=1, external_death=1)
    assert (r["recovered"], r["death"], r["external_death"], r["adj_death_date"]) == (0, 1, 1, D(2016, 1, 1))


def test_on_the_same_day_death_wins(spark):
    r = reconciled(spark, recovery_op=D(2016, 1, 1), death_date=D(2016, 1, 1), death=1)
    assert (r["recovered"], r["death"]) == (0, 1)


def test_an_unrecovered_date_can_still_cancel_a_death(spark):
    r = reconciled(spark, recovered_rx=0, recovery_op=D(2016, 1, 1), death_date=D(2018, 1, 1), death=1)
    assert (r["recovered"], r["death"]) == (0, 0)


ONSET = (
    "entity_id int, entry_date date, progression_date date, adj_death_date date, adj_recovery_date date"
)


def with_history(spark, master, events):
    conditions = spark.createDataFrame(events, "entity_id int, event_date date, name string, code string, type string")
    return cohort.attach_history(spark.createDataFrame(master, ONSET), conditions)


@pytest.mark.parametrize("day, before, after", [
    (D(2014, 12, 31), 0, 0),
    (D(2015, 1, 1), 1, 0),      # on entry
    (D(2016, 12, 31), 1, 0),
    (D(2017, 1, 1), 0, 1),      # on progression
    (D(2018, 6, 1), 0, 1),      # on the end
    (D(2018, 6, 2), 0, 0),
])
def test_onset_window_edges(spark, day, before, after):
    df = with_history(
        spark, [(1, D(2015, 1, 1), D(2017, 1, 1), D(2018, 6, 1), FUTURE)], [(1, day, "n", "c", "Somatic")]
    )
    out = cohort.onset_after_progression(cohort.onset_before_progression(df, DEFAULT_DATES), DEFAULT_DATES).first()
    assert (out["pre_onset"], out["post_onset"]) == (before, after)
    assert out["pre_onset_date"] == (day if before else None)
    assert out["post_onset_type"] == ("Somatic" if after else "None")


def test_progression_on_the_last_day_has_no_window_after_it(spark):
    end = DEFAULT_DATES.study_end
    df = with_history(spark, [(1, D(2015, 1, 1), end, FUTURE, FUTURE)], [(1, end, "n", "c", "Mental")])
    assert cohort.onset_after_progression(df, DEFAULT_DATES).first()["post_onset"] == 0


def test_first_onset_of_several_and_none(spark):
    master = [(1, D(2015, 1, 1), None, FUTURE, FUTURE), (2, D(2015, 1, 1), None, FUTURE, FUTURE)]
    events = [(1, D(2016, 1, 1), "b", "c", "Mental"), (1, D(2016, 1, 1), "a", "c", "Somatic"), (1, D(2015, 5, 1), "z", "c", "Mental")]
    out = cohort.onset_before_progression(with_history(spark, master, events), DEFAULT_DATES).orderBy("entity_id").collect()
    assert (out[0]["pre_onset_date"], out[0]["pre_onset_type"]) == (D(2015, 5, 1), "Mental")
    assert (out[1]["pre_onset"], out[1]["pre_onset_date"], out[1]["pre_onset_type"]) == (0, None, "None")


def test_follow_up_age_and_progression(spark):
    df = spark.createDataFrame([
        (1, D(2014, 5, 1), D(1990, 1, 1), None),
        (2, D(2014, 5, 1), D(1990, 1, 1), D(2014, 5, 1)),     # ends on entry
        (3, D(2014, 5, 1), D(2004, 1, 1), None),              # too young
        (4, D(2014, 5, 1), D(2003, 12, 31), D(2014, 5, 2)),
    ], "entity_id int, entry_date date, birth_date date, death_date date")
    kept = cohort.min_age(cohort.follow_up(df, DEFAULT_DATES))
    assert [(r["entity_id"], r["follow_up_days"]) for r in kept.orderBy("entity_id").collect()] == [(1, 2437), (4, 2)]
    dates = spark.createDataFrame([(1, D(2020, 12, 31)), (4, D(2021, 1, 1))], "entity_id int, progression_date date")
    out = {r["entity_id"]: (r["progressed"], r["progression_date"]) for r in cohort.progression(kept, dates, DEFAULT_DATES).collect()}
    assert out == {1: (1, D(2020, 12, 31)), 4: (0, D(2021, 1, 1))}


def test_causes_of_death(spark):
    rows = [(1, D(2016, 1, 1), "X60", None), (2, D(2016, 1, 1), "I21", "J18"), (3, D(2021, 2, 1), "X60", None),
            (4, None, None, None), (5, D(2016, 1, 1), None, "W19")]
    df = spark.createDataFrame(rows, "entity_id int, death_date date, main_cause string, other_cause string")
    out = cohort.death_cause(df, DEFAULT_DATES).orderBy("entity_id").collect()
    assert [(r["death"], r["external_death"], r["natural_death"]) for r in out] == [(1, 1, 0), (1, 0, 1), (0, 0, 0), (0, 0, 0), (1, 1, 0)]


def test_refresh_takes_the_newer_file_and_drops_the_unknown(spark):
    old = spark.createDataFrame([(1, "a", D(2010, 1, 1)), (2, "b", None), (3, "c", None)], "entity_id int, x string, death_date date")
    newer = spark.createDataFrame([(1, None), (2, D(2016, 1, 1)), (2, D(2016, 1, 1))], "entity_id int, death_date date")
    out = cohort.refresh_death(old, [newer, newer], ["death_date"]).orderBy("entity_id").collect()
    assert [(r["entity_id"], r["x"], r["death_date"]) for r in out] == [(1, "a", None), (2, "b", D(2016, 1, 1))]


def test_sources_one_pass_equals_step_by_step(spark):
    records = spark.createDataFrame([(1, D(2019, 1, 1)), (1, D(2018, 1, 1)), (2, D(2021, 1, 1)), (2, D(2019, 1, 1))], "entity_id int, date date")
    master = spark.createDataFrame([(1,), (2,), (3,)], "entity_id int")
    out = cohort.recovery_sources(master, {"op": records, "rx": records}, DEFAULT_DATES, {"op": 180, "rx": 0}).orderBy("entity_id").collect()
    assert [(r["recovered_op"], r["recovery_op"], r["recovery_rx"]) for r in out] == [
        (1, D(2019, 6, 30), D(2019, 1, 1)), (0, None, None), (1, None, None)]
    active = cohort.active_after(records, "date", DEFAULT_DATES.activity_cutoff)
    last = cohort.last_relevant(records, "date", active, 180, "recovery_op").collect()
    assert [(r[0], r[1]) for r in last] == [(1, D(2019, 6, 30))]


def test_drug_filter(spark):
    rx = spark.createDataFrame([(1, "CETI01", "4.3.1"), (2, "CETI01", "4.3.3"), (3, "OTHER", "4.3.1"), (4, "CETI01", None)], "id int, drug_code string, drug_class string")
    listed = spark.createDataFrame([("CETI01",)], "drug_code string")
    out = cohort.drug_filter(rx, listed, "CETI01", "4.3.1")
    assert sorted(r["id"] for r in out.collect()) == [2, 4]


def test_rules_find_nothing_in_a_sound_row(spark):
    r = dict(entry_date=D(2015, 1, 1), progression_date=D(2015, 5, 1), progressed=1, recovered=1, death=0,
             adj_recovery_date=D(2016, 1, 1), adj_death_date=FUTURE, pre_onset_date=D(2015, 2, 1), post_onset_date=D(2015, 6, 1))
    schema = ", ".join(f"{k} {'date' if k.endswith('date') else 'int'}" for k in r)
    good = cohort.check_timeline(spark.createDataFrame([tuple(r.values())], schema))
    assert good.agg(F.sum("violations")).first()[0] == 0
    r["progression_date"] = D(2016, 1, 1)
    bad = cohort.check_timeline(spark.createDataFrame([tuple(r.values())], schema))
    assert {x["rule"] for x in bad.where("violations > 0").collect()} == {"progression_not_before_recovery", "post_onset_before_progression"}


def test_refresh_death_keeps_one_row_of_files_that_disagree(spark):
    master = spark.createDataFrame([(1, None), (2, None)], "entity_id long, death_date date")
    old = spark.createDataFrame([(1, date(2015, 1, 1)), (2, None)], "entity_id long, death_date date")
    new = spark.createDataFrame([(1, date(2016, 2, 2)), (1, date(2017, 1, 1))], "entity_id long, death_date date")
    got = cohort.refresh_death(master, [old, new], ["death_date"]).collect()
    assert sorted(map(tuple, got)) == [(1, date(2016, 2, 2)), (2, None)]
