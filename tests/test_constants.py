"""Fixed values stated a second time: queries and their SQL share the constants, so a wrong one would pass on both sides."""

from lifeledger.operators import cost
from lifeledger.survival.sample import CHOSEN, CURVES, TRANSITIONS


def test_prices():
    assert cost.ED_PRICE == 1230
    assert cost.WARD_TARIFFS == {"general": 5100, "psy": 2340, "high": 13650, "icu": 24400}
    assert cost.SERVICE_PRICES == {
        "pdh": 1260, "gdh": 1960, "rdh": 1320, "gopc": 445, "sopc_gen": 1190, "sopc_psy": 1190, "sopc_ah": 1190,
        "com_gen": 535, "com_psy": 1550, "com_ah": 1730, "injection": 100,
    }


def test_rates_cover_every_setting():
    assert set(cost.RATE_COLUMNS) == {
        "overall_cost", "ip_cost", "op_cost", "ed_cost", "overall_psy_cost", "ip_psy_cost", "op_psy_cost"}


# Origin, outcome, flag, competing dates and required flag of the study's twelve transitions.
DEATH, RECOVERY, PROGRESSION, PRE, POST = "adj_death_date", "adj_recovery_date", "progression_date", "pre_onset_date", "post_onset_date"
TWELVE = [
    ("base_progression", "entry_date", PROGRESSION, "progressed", {DEATH, RECOVERY, PRE}, None, "lognormal"),
    ("base_comorbid", "entry_date", PRE, "pre_onset", {DEATH, RECOVERY, PROGRESSION}, None, "weibull"),
    ("base_death", "entry_date", DEATH, "death", {RECOVERY, PROGRESSION, PRE}, None, "loglogistic"),
    ("base_recovery", "entry_date", RECOVERY, "recovered", {DEATH, PROGRESSION, PRE}, None, "lognormal"),
    ("progressed_comorbid", PROGRESSION, POST, "post_onset", {DEATH, RECOVERY}, "progressed", "weibull"),
    ("progressed_death", PROGRESSION, DEATH, "death", {RECOVERY, POST}, "progressed", "loglogistic"),
    ("progressed_recovery", PROGRESSION, RECOVERY, "recovered", {DEATH, POST}, "progressed", "weibull"),
    ("comorbid_progression", PRE, PROGRESSION, "progressed", {DEATH, RECOVERY}, None, "lognormal"),
    ("comorbid_death", PRE, DEATH, "death", {RECOVERY, PROGRESSION}, "pre_onset", "lognormal"),
    ("comorbid_recovery", "entry_date", RECOVERY, "recovered", {DEATH, PROGRESSION}, "pre_onset", "loglogistic"),
    ("progressed_comorbid_death", POST, DEATH, "death", {RECOVERY}, "post_onset", "weibull"),
    ("progressed_comorbid_recovery", POST, RECOVERY, "recovered", {DEATH}, "post_onset", "lognormal"),
]


def test_transitions():
    assert list(CHOSEN) == [row[0] for row in TWELVE]
    for name, origin, outcome, flag, competing, require, dist in TWELVE:
        t = TRANSITIONS[name]
        assert (t.origin, t.outcome, t.flag, set(t.competing), t.require, t.unit) == (origin, outcome, flag, competing, require, "years"), name
        assert CHOSEN[name] == dist
    for name, outcome, competing in (("validate_death", DEATH, (RECOVERY,)), ("validate_recovery", RECOVERY, (DEATH,))):
        t = TRANSITIONS[name]
        assert (t.origin, t.outcome, t.competing, t.require, t.unit) == ("entry_date", outcome, competing, None, "days")


def test_curves_are_those_of_lognormal_models():
    assert CURVES == tuple(row[0] for row in TWELVE if row[-1] == "lognormal")
