"""Stand-in source tables: which benchmark columns play which role.

Every role is given twice, as a DataFrame and as the same statement in SQL (``CTES``), so that
composite queries can be checked from raw tables to result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeledger.functions import add_days, any_column_matches, completed_years
from lifeledger.operators import cohort, cost, markov, matching
from lifeledger.operators.aggregates import nth_per_key
from lifeledger.operators.cohort import StudyDates
from lifeledger.operators.relational import inner
from lifeledger.plans.study import Inputs, costed_cohort, master_table
from lifeledger.session import store
from lifeledger.sources.extracts import load_table, save_table

# The calendar of the stand-in study and its code lists.
DATES = StudyDates(
    accrual_start=date(1996, 1, 1), accrual_end=date(1998, 12, 31), study_end=date(2000, 12, 31),
    activity_cutoff=date(2001, 1, 1), far_past=date(1980, 1, 1), far_future=date(2002, 12, 31),
)
QUALIFYING = "1-URGENT"
EMERGENCY = "2-HIGH"
DEATH_PRICE = 350000
RELEVANT_CODES = "Brand#3.|Brand#8.SMALL"
CONDITION_CODES = [
    ("Brand#13.ECONOMY", "renal", "Somatic"),
    ("Brand#1[34].(ECONOMY|SMALL)", "cardiac", "Somatic"),
    ("Brand#17.S", "diabetes", "Somatic"),
    ("Brand#2[12].PROMO", "anxiety", "Mental"),
    ("Brand#9.LARGE|Brand#9.MEDIUM", "substance", "Mental"),
]
DRUG_LIST = ["Brand#6", "Brand#11"]
EXCLUDED_DRUG = ("Brand#11", "PROMO")
SERVICE_TYPES = [
    "AHPD", "PDH", "AHGD", "GDH", "GDHX", "AHRD", "RDP", "RDPC", "RDPN", "RDPP", "AHJ", "AHOO", "AHOP", "AHTC",
    "CEOL", "CGAT", "CVMO", "ICMD", "ICMN", "AHC", "ICMA", "OTHER", None,
]
SERVICE_GROUPS = [
    "GOP", "GOP IPC", "NAHC", "RAMP", "Smoking Cessation", "FM", "NUR", "SOP", "C - Community Service",
    "Community Psychiatric Services", "PG Outreach", "Dressing", "GOP Injection", "Other", None,
]
SPECIALTIES = [
    "GOAD", "CGAS", "DH", "MPMG", "MPMR", "PC", "PCR", "PCNC", "CPLD", "DPGC", "DPGN", "ICM", "POAH", "CSAC",
    "DPPC", "DPPN", "PGER", "PPSY", "PSY", "SPSY", "STUC", "MED", None,
]
SUB_SPECIALTIES = ["VITO", "VITP", "VOS", "DHOT", "DHPT", "OT", "PT", "GEN", None]
EIS_SPECIALTIES = ["PSY", "MED", None]
ED_COLUMNS = [f"dx_{i}" for i in range(1, 8)]
STAY_COLUMNS = ["dx_1", "dx_2", "dx_3"]
STRATA = ["cohort_year", "sex", "age_band"]
#: What the roles read of a line item, its order and its part.
LINE_COLUMNS = [
    "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_returnflag", "l_linestatus", "l_shipdate", "p_name", "p_brand", "p_type", "p_size",
]


def _pick(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


class Tables:
    """The given tables of one scale factor, and the roles derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    # Roles

    @cached_property
    def entities(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customer.select(
            key.alias("entity_id"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
            F.date_sub(F.lit(date(1990, 1, 1)), (key * 37 % 25000).cast("int")).alias("birth_date"),
            F.col("c_nationkey").alias("district"),
        )

    @cached_property
    def index_records(self) -> DataFrame:
        return self.orders.where(F.col("o_orderpriority") == QUALIFYING).select(
            F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("event_date"),
            F.col("o_orderkey").alias("record_id"),
        )

    @cached_property
    def death_updates(self) -> DataFrame:
        """Everybody's last order; a dear one is a death."""
        fields = ["o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
        last = self.orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.max(F.struct(*fields)).alias("o"))
        died = F.col("o.o_totalprice") > DEATH_PRICE
        return self.entities.select("entity_id").join(last, on="entity_id", how="left").select(
            "entity_id",
            F.when(died, F.col("o.o_orderdate")).alias("death_date"),
            F.when(died, F.col("o.o_orderpriority")).alias("main_cause"),
            F.when(died, F.col("o.o_orderstatus")).alias("other_cause"),
        )

    @cached_property
    def incident_keys(self) -> DataFrame:
        first = self.index_records.groupBy("entity_id").agg(F.min("event_date").alias("first_date"))
        return first.where(F.col("first_date") >= DATES.accrual_start).select("entity_id")

    @cached_property
    def third_records(self) -> DataFrame:
        """Third qualifying record, whenever it falls."""
        return nth_per_key(self.index_records, ["entity_id"], ["event_date", "record_id"], 3).select(
            "entity_id", F.col("event_date").alias("progression_date")
        )

    @cached_property
    def progression_dates(self) -> DataFrame:
        """Third qualifying record, if it falls before death and before the entity may count as recovered.

        Recovery lies after the last relevant record and after the grace period from the first one.
        """
        key = ["entity_id"]
        first = self.index_records.groupBy(*key).agg(F.min("event_date").alias("first_date"))
        last = self.activity["op"].groupBy(*key).agg(F.max("date").alias("last_date"))
        known = self.third_records.join(first, key).join(last, key, "left").join(self.death_updates, key, "left")
        date = F.col("progression_date")
        ill = (date < F.col("last_date")) | (date < add_days(F.col("first_date"), cohort.GRACE_DAYS))
        alive = F.col("death_date").isNull() | (date < F.col("death_date"))
        return known.where(ill & alive).select("entity_id", "progression_date")

    @cached_property
    def joined_lines(self) -> DataFrame:
        """Line items with their order and their part."""
        return self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            self.part, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with the customer and date of their order and the code of their part."""
        return self.joined_lines.withColumn("entity_id", F.col("o_custkey")).withColumn("code", F.concat_ws(".", "p_brand", "p_type"))

    @cached_property
    def prepared(self) -> Tables:
        """The same tables with the line items joined once and saved, for queries that read them in many roles.

        Every role has its own join otherwise, and the shuffles of nine joins of the largest table lie on disk together.
        """
        out = Tables(self.spark, self.dir)
        saved = load_table(self.spark, save_table(self.joined_lines.select(*LINE_COLUMNS), "lines"))
        out.joined_lines = saved.withColumn("l_orderkey", F.col("o_orderkey"))
        return out

    @cached_property
    def code_table(self) -> DataFrame:
        return self.spark.createDataFrame(CONDITION_CODES, "pattern string, name string, type string")

    @cached_property
    def drug_list(self) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in DRUG_LIST], "drug_code string")

    @cached_property
    def diagnoses(self) -> DataFrame:
        return self.lines.select("entity_id", F.col("l_shipdate").alias("event_date"), "code")

    @cached_property
    def outpatient_dx(self) -> DataFrame:
        return self.lines.select(
            "entity_id", F.col("l_shipdate").alias("visit_date"), F.col("code").alias("dx_code")
        )

    @cached_property
    def ed_visits(self) -> DataFrame:
        emergency = self.lines.where(F.col("o_orderpriority") == EMERGENCY)
        per_order = emergency.groupBy("entity_id", "o_orderkey", "o_orderdate").agg(
            *[F.min(F.when(F.col("l_linenumber") == i + 1, F.col("code"))).alias(c) for i, c in enumerate(ED_COLUMNS)]
        )
        return per_order.select(
            "entity_id", F.col("o_orderdate").alias("attend_date"),
            add_days(F.col("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")).alias("discharge_date"),
            *ED_COLUMNS,
        )

    @cached_property
    def ward_stays(self) -> DataFrame:
        text = F.col("l_quantity").cast("int").cast("string")
        flag, status, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
        return self.lines.where(F.col("l_shipdate") >= F.col("o_orderdate")).select(
            "entity_id", F.col("o_orderdate").alias("admit_date"), F.col("l_shipdate").alias("discharge_date"),
            F.col("code").alias("dx_1"), F.col("p_name").alias("dx_2"), F.col("p_type").alias("dx_3"),
            F.when(flag == "A", text).alias("los_acute"),
            F.when((flag == "N") & (status == "F"), text).alias("los_convalescent"),
            F.when((flag == "N") & (status == "O") & (number <= 4), text).alias("los_high"),
            F.when((flag == "N") & (status == "O") & (number > 4), text).alias("los_icu"),
            F.when(flag == "R", F.when(number == 7, "x").otherwise(text)).alias("los_psy"),
        )

    @cached_property
    def prescriptions(self) -> DataFrame:
        return self.lines.select(
            "entity_id", F.col("p_brand").alias("drug_code"), F.col("p_type").alias("drug_class"),
            F.col("l_shipdate").alias("start_date"),
            add_days(F.col("l_shipdate"), F.col("l_quantity").cast("int")).alias("end_date"),
        )

    @cached_property
    def services(self) -> DataFrame:
        return self.lines.select(
            "entity_id", F.col("l_shipdate").alias("visit_date"),
            _pick(SERVICE_TYPES, F.col("l_partkey")).alias("service_type"),
            _pick(SERVICE_GROUPS, F.col("l_suppkey")).alias("service_group"),
            _pick(SPECIALTIES, F.col("p_size")).alias("specialty"),
            _pick(SUB_SPECIALTIES, F.col("l_linenumber")).alias("sub_specialty"),
            _pick(EIS_SPECIALTIES, F.col("l_orderkey")).alias("eis_specialty"),
        )

    # Derived stages

    @cached_property
    def conditions(self) -> DataFrame:
        return cohort.first_conditions(self.diagnoses, self.code_table)

    @cached_property
    def activity(self) -> dict[str, DataFrame]:
        def relevant(df: DataFrame, columns: Sequence[str], when: str) -> DataFrame:
            hits = df.where(any_column_matches([F.col(c) for c in columns], RELEVANT_CODES))
            return hits.select("entity_id", F.col(when).alias("date"))

        drugs = cohort.drug_filter(self.prescriptions, self.drug_list, *EXCLUDED_DRUG)
        return {
            "op": relevant(self.outpatient_dx, ["dx_code"], "visit_date"),
            "ae": relevant(self.ed_visits, ED_COLUMNS, "attend_date"),
            "ip": relevant(self.ward_stays, STAY_COLUMNS, "discharge_date"),
            "rx": drugs.select("entity_id", F.col("end_date").alias("date")),
        }

    @cached_property
    def inputs(self) -> Inputs:
        return Inputs(
            self.index_records, self.entities, (self.death_updates,), self.incident_keys,
            self.progression_dates, self.conditions, self.activity,
        )

    @cached_property
    def indexed_entities(self) -> DataFrame:
        return inner(cohort.index_event(self.index_records, DATES, ["record_id"]).drop("record_id"),
                     self.entities, "entity_id")

    @cached_property
    def master(self) -> DataFrame:
        return master_table(self.inputs, DATES)

    @cached_property
    def unchecked_master(self) -> DataFrame:
        """The master with every progression, also those that the checks of the timeline are there to find."""
        return master_table(replace(self.inputs, progression_dates=self.third_records), DATES)

    @cached_property
    def stored_master(self) -> DataFrame:
        """The master for stages that read it more than once."""
        return store(self.prepared.master)

    @cached_property
    def matched(self) -> DataFrame:
        """Matched sets that SQL can state: every case, with up to four controls of its year, sex and age band."""
        return matching.match_strata(self.stored_master, "entity_id", "progressed", STRATA)

    @cached_property
    def indexed(self) -> DataFrame:
        return matching.stack_cohorts([matching.share_case_date(self.matched)])

    @cached_property
    def costed(self) -> DataFrame:
        records = self.prepared
        return costed_cohort(store(self.indexed), records.ed_visits, records.ward_stays, records.services)

    @cached_property
    def rates(self) -> DataFrame:
        return cost.cost_rates(self.costed)

    @cached_property
    def stored_rates(self) -> DataFrame:
        """The rates for models, which read them more than once."""
        return store(self.rates)

    # Markov parameters, counted from the tables

    @cached_property
    def people(self) -> DataFrame:
        """Every entity with its first qualifying year and its subgroup: band fastest, then history, then sex."""
        first = self.index_records.groupBy("entity_id").agg(F.min("event_date").alias("first_date"))
        joined = first.join(self.customer.select(F.col("c_custkey").alias("entity_id"), "c_acctbal"), on="entity_id")
        joined = joined.join(self.entities, on="entity_id")
        age = completed_years(F.col("birth_date"), F.col("first_date"))
        place = F.when(age <= 24, 0).when(age <= 40, 1).when(age <= 65, 2).otherwise(3)
        history, male = (F.col("c_acctbal") < 5000).cast("int"), (F.col("sex") == "M").cast("int")
        return joined.select(
            "entity_id", F.year("first_date").alias("cohort"), (place + 4 * history + 8 * male).alias("subgroup")
        )

    @cached_property
    def incidence(self) -> DataFrame:
        return self.people.groupBy("cohort").agg(F.count(F.lit(1)).alias("incidence"))

    @cached_property
    def weights(self) -> DataFrame:
        from pyspark.sql import Window

        counts = self.people.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n"))
        everyone = F.sum("n").over(Window.partitionBy(F.lit(0)))
        return counts.select("subgroup", (F.col("n") / everyone).alias("weight"))

    @cached_property
    def probability_blocks(self) -> DataFrame:
        """Wide blocks (subgroup, t, p0 ... p15): line items counted, one added, shares per source state."""
        slots = self.lineitem.select(
            "l_orderkey", (F.col("l_partkey") % markov.PERIOD).cast("int").alias("t"),
            (F.col("l_suppkey") % markov.N_PROBABILITIES).cast("int").alias("ix"),
        )
        keyed = slots.join(
            self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity_id")),
            on="l_orderkey",
        ).join(self.people.select("entity_id", "subgroup"), on="entity_id")
        counts = keyed.groupBy("subgroup", "t").agg(
            *[(F.count_if(F.col("ix") == i) + 1).alias(f"n{i}") for i in range(markov.N_PROBABILITIES)]
        )
        shares = []
        for targets in markov.TRANSITIONS.values():
            total = sum((F.col(f"n{i}") for i in targets.values()), start=F.lit(0))
            shares += [(i, F.col(f"n{i}") / total) for i in targets.values()]
        return counts.select("subgroup", "t", *[s.alias(f"p{i}") for i, s in sorted(shares, key=lambda x: x[0])])

    @cached_property
    def state_costs(self) -> DataFrame:
        spent = self.orders.select(
            F.col("o_custkey").alias("entity_id"), "o_totalprice",
            _pick(markov.STATES[:4], F.col("o_orderkey")).alias("state"),
        )
        return spent.join(self.people, on="entity_id").groupBy("state", "subgroup").agg(
            F.round(F.avg("o_totalprice"), 2).alias("cost")
        )


def _sql_text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _sql_pick(values: Sequence, index: str) -> str:
    return f"([{', '.join(_sql_text(v) for v in values)}])[1 + {index} % {len(values)}]"


def _sql_years(birth: str, ref: str) -> str:
    return (
        f"CAST(year({ref}) - year({birth}) - CASE WHEN month({ref}) < month({birth}) OR "
        f"(month({ref}) = month({birth}) AND day({ref}) < day({birth})) THEN 1 ELSE 0 END AS INTEGER)"
    )


def _sql_any(columns: Sequence[str], pattern: str) -> str:
    joined = ", ".join(f"coalesce({c}, 'NA')" for c in columns)
    return f"regexp_matches(concat_ws(' ', {joined}), '{pattern}')"


def _sql_date(d: date) -> str:
    return f"DATE '{d.isoformat()}'"


START, END = _sql_date(DATES.accrual_start), _sql_date(DATES.accrual_end)
STUDY_END, CUTOFF = _sql_date(DATES.study_end), _sql_date(DATES.activity_cutoff)
PAST, FUTURE = _sql_date(DATES.far_past), _sql_date(DATES.far_future)

# SQL of every role and stage, in order of dependency. Prefixes: r role, m master, c cost, k Markov.
CTES: dict[str, str] = {}
CTES["r_entities"] = """
  SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    DATE '1990-01-01' - CAST(c_custkey * 37 % 25000 AS INTEGER) AS birth_date, c_nationkey AS district
  FROM customer"""
CTES["r_index"] = f"""
  SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS event_date, o_orderkey AS record_id
  FROM orders WHERE o_orderpriority = '{QUALIFYING}'"""
CTES["r_death"] = f"""
  SELECT e.entity_id, CASE WHEN died THEN d END AS death_date, CASE WHEN died THEN o_orderpriority END AS main_cause,
    CASE WHEN died THEN o_orderstatus END AS other_cause
  FROM r_entities e LEFT JOIN (
    SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderpriority, o_orderstatus,
      o_totalprice > {DEATH_PRICE} AS died FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
  ) o ON o.o_custkey = e.entity_id"""
CTES["r_incident"] = f"""
  SELECT entity_id FROM r_index GROUP BY entity_id HAVING min(event_date) >= {START}"""
CTES["r_lines"] = """
  SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date,
    p_brand || '.' || p_type AS code, o_orderkey, o_orderpriority, l_linenumber, l_quantity, l_returnflag,
    l_linestatus, l_partkey, l_suppkey, l_extendedprice, p_brand, p_type, p_name, p_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
CTES["r_codes"] = (
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql_text(v) for v in row) + ")" for row in CONDITION_CODES)
    + ") t(pattern, name, type)"
)
CTES["r_drugs"] = "SELECT * FROM (VALUES " + ", ".join(f"({_sql_text(d)})" for d in DRUG_LIST) + ") t(drug_code)"
CTES["r_dx"] = "SELECT entity_id, ship_date AS event_date, code FROM r_lines"
CTES["r_ed"] = f"""
  SELECT entity_id, order_date AS attend_date, order_date + CAST(o_orderkey % 5 AS INTEGER) AS discharge_date,
    {', '.join(f"min(CASE WHEN l_linenumber = {i + 1} THEN code END) AS {c}" for i, c in enumerate(ED_COLUMNS))}
  FROM r_lines WHERE o_orderpriority = '{EMERGENCY}' GROUP BY entity_id, o_orderkey, order_date"""
CTES["r_stays"] = """
  SELECT entity_id, order_date AS admit_date, ship_date AS discharge_date, code AS dx_1, p_name AS dx_2, p_type AS dx_3,
    CASE WHEN l_returnflag = 'A' THEN q END AS los_acute,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN q END AS los_convalescent,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber <= 4 THEN q END AS los_high,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber > 4 THEN q END AS los_icu,
    CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber = 7 THEN 'x' ELSE q END END AS los_psy
  FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM r_lines) l WHERE ship_date >= order_date"""
CTES["r_rx"] = """
  SELECT entity_id, p_brand AS drug_code, p_type AS drug_class, ship_date AS start_date,
    ship_date + CAST(l_quantity AS INTEGER) AS end_date FROM r_lines"""
CTES["r_services"] = f"""
  SELECT entity_id, ship_date AS visit_date, {_sql_pick(SERVICE_TYPES, 'l_partkey')} AS service_type,
    {_sql_pick(SERVICE_GROUPS, 'l_suppkey')} AS service_group, {_sql_pick(SPECIALTIES, 'p_size')} AS specialty,
    {_sql_pick(SUB_SPECIALTIES, 'l_linenumber')} AS sub_specialty,
    {_sql_pick(EIS_SPECIALTIES, 'o_orderkey')} AS eis_specialty FROM r_lines"""
CTES["r_mapped"] = "SELECT d.*, c.name, c.type FROM r_dx d JOIN r_codes c ON regexp_matches(d.code, c.pattern)"
CTES["r_conditions"] = """
  SELECT entity_id, event_date, code, name, type FROM r_mapped
  QUALIFY row_number() OVER (PARTITION BY entity_id, name ORDER BY event_date, code, type) = 1"""
CTES["r_rx_kept"] = f"""
  SELECT r.* FROM r_rx r JOIN r_drugs USING (drug_code)
  WHERE NOT (regexp_matches(drug_code, '{EXCLUDED_DRUG[0]}') AND regexp_matches(drug_class, '{EXCLUDED_DRUG[1]}'))"""
CTES["r_activity"] = f"""
  SELECT entity_id, ship_date AS date, 'op' AS source FROM r_lines WHERE {_sql_any(['code'], RELEVANT_CODES)}
  UNION ALL SELECT entity_id, attend_date, 'ae' FROM r_ed WHERE {_sql_any(ED_COLUMNS, RELEVANT_CODES)}
  UNION ALL SELECT entity_id, discharge_date, 'ip' FROM r_stays WHERE {_sql_any(STAY_COLUMNS, RELEVANT_CODES)}
  UNION ALL SELECT entity_id, end_date, 'rx' FROM r_rx_kept"""
CTES["r_progression"] = f"""
  SELECT entity_id, event_date AS progression_date FROM (
    SELECT *, min(event_date) OVER (PARTITION BY entity_id) AS first_date FROM r_index
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_date, record_id) = 3
  ) i LEFT JOIN r_death USING (entity_id)
    LEFT JOIN (SELECT entity_id, max(date) AS last_date FROM r_activity WHERE source = 'op' GROUP BY entity_id) a USING (entity_id)
  WHERE (event_date < last_date OR event_date < first_date + {cohort.GRACE_DAYS}) AND (death_date IS NULL OR event_date < death_date)"""
# What ``r_progression`` is for a statement over every third record (``Tables.third_records``).
EVERY_PROGRESSION = """
  SELECT entity_id, event_date AS progression_date FROM r_index
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_date, record_id) = 3"""
CTES["m_index"] = f"""
  SELECT i.entity_id, i.entry_date, e.sex, e.birth_date, e.district FROM (
    SELECT entity_id, event_date AS entry_date FROM r_index WHERE event_date BETWEEN {START} AND {END}
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_date, record_id) = 1
  ) i JOIN r_entities e USING (entity_id)"""
CTES["m_follow"] = f"""
  SELECT * FROM (
    SELECT i.*, d.death_date, d.main_cause, d.other_cause, coalesce(d.death_date, {STUDY_END}) AS follow_up_end,
      coalesce(d.death_date, {STUDY_END}) - i.entry_date + 1 AS follow_up_days
    FROM m_index i JOIN r_death d USING (entity_id)
  ) f WHERE follow_up_days > 1"""
CTES["m_aged"] = "SELECT * FROM m_follow WHERE birth_date <= make_date(year(entry_date) - 11, 12, 31)"
CTES["m_incident"] = "SELECT * FROM m_aged WHERE entity_id IN (SELECT entity_id FROM r_incident)"
CTES["m_progression"] = f"""
  SELECT m.*, p.progression_date,
    CASE WHEN coalesce(p.progression_date, {FUTURE}) <= {STUDY_END} THEN 1 ELSE 0 END AS progressed
  FROM m_incident m LEFT JOIN r_progression p USING (entity_id)"""
CTES["m_entry"] = f"""
  SELECT *, CASE WHEN age <= 24 THEN '10-24' WHEN age <= 40 THEN '25-40' WHEN age <= 65 THEN '41-65' ELSE '65+' END
    AS age_band, CAST(year(entry_date) AS INTEGER) AS cohort_year
  FROM (SELECT *, {_sql_years('birth_date', 'entry_date')} AS age FROM m_progression) a"""
CTES["m_baseline"] = """
  SELECT m.*, coalesce(b.somatic, 0) AS baseline_somatic, coalesce(b.mental, 0) AS baseline_mental,
    greatest(coalesce(b.somatic, 0), coalesce(b.mental, 0)) AS baseline_any
  FROM m_entry m LEFT JOIN (
    SELECT entity_id, max(CASE WHEN type = 'Somatic' THEN 1 ELSE 0 END) AS somatic,
      max(CASE WHEN type = 'Mental' THEN 1 ELSE 0 END) AS mental
    FROM r_conditions JOIN m_entry USING (entity_id) WHERE event_date < entry_date GROUP BY entity_id
  ) b USING (entity_id)"""
CTES["m_cause"] = f"""
  SELECT *, CASE WHEN death = 1 AND ext THEN 1 ELSE 0 END AS external_death,
    CASE WHEN death = 1 AND NOT ext THEN 1 ELSE 0 END AS natural_death
  FROM (SELECT *, CASE WHEN death_date <= {STUDY_END} THEN 1 ELSE 0 END AS death,
      coalesce(regexp_matches(main_cause, '[STVWXY]'), false)
      OR coalesce(regexp_matches(other_cause, '[STVWXY]'), false) AS ext FROM m_baseline) b"""
CTES["m_sources"] = f"""
  SELECT m.*, {', '.join(
    f"CASE WHEN last_{s} >= {CUTOFF} THEN 0 ELSE 1 END AS recovered_{s}, "
    f"CASE WHEN last_{s} < {CUTOFF} THEN last_{s} + {0 if s == 'rx' else 180} END AS recovery_{s}"
    for s in cohort.SOURCES)}
  FROM m_cause m LEFT JOIN (
    SELECT entity_id, {', '.join(f"max(date) FILTER (source = '{s}') AS last_{s}" for s in cohort.SOURCES)}
    FROM r_activity GROUP BY entity_id) a USING (entity_id)"""
CTES["m_step1"] = f"""
  SELECT *, CASE WHEN recovered_op = 0 OR recovered_ip = 0 OR recovered_ae = 0 OR recovered_rx = 0 THEN 0 ELSE 1 END
      AS recovered1,
    greatest(coalesce(recovery_op, {PAST}), coalesce(recovery_rx, {PAST}), coalesce(recovery_ip, {PAST}),
      coalesce(recovery_ae, {PAST})) AS latest, coalesce(death_date, {FUTURE}) AS death_filled FROM m_sources"""
CTES["m_step2"] = f"""
  SELECT *, CASE WHEN latest = {PAST} AND recovered1 = 1 THEN entry_date + 180
    WHEN latest = {PAST} THEN {FUTURE} ELSE latest END AS recovery2 FROM m_step1"""
CTES["m_step3"] = f"""
  SELECT *, CASE WHEN recovery2 >= {CUTOFF} THEN 0 ELSE recovered1 END AS recovered3,
    greatest(CASE WHEN recovery2 >= {CUTOFF} THEN {FUTURE} ELSE recovery2 END, entry_date + 180) AS recovery3
  FROM m_step2"""
CTES["m_step4"] = """
  SELECT * EXCLUDE (death), CASE WHEN recovery3 < death_filled THEN 0 ELSE death END AS death,
    CASE WHEN death_filled <= recovery3 THEN 0 ELSE recovered3 END AS recovered FROM m_step3"""
CTES["m_reconciled"] = f"""
  SELECT entity_id, entry_date, sex, birth_date, district, main_cause, other_cause, follow_up_end, follow_up_days,
    progression_date, progressed, age, age_band, cohort_year, baseline_somatic, baseline_mental, baseline_any, death,
    recovered, {', '.join(f'recovered_{s}, recovery_{s}' for s in cohort.SOURCES)},
    CASE WHEN death = 0 THEN {FUTURE} ELSE death_filled END AS adj_death_date,
    CASE WHEN recovered = 0 THEN {FUTURE} ELSE recovery3 END AS adj_recovery_date,
    nullif(death_filled, {FUTURE}) AS death_date, nullif(recovery3, {FUTURE}) AS recovery_date,
    CASE WHEN death = 0 THEN 0 ELSE natural_death END AS natural_death,
    CASE WHEN death = 0 THEN 0 ELSE external_death END AS external_death FROM m_step4"""
CTES["m_onset1"] = f"""
  SELECT m.*, coalesce(o.one, 0) AS pre_onset, coalesce(o.type, 'None') AS pre_onset_type,
    o.event_date AS pre_onset_date
  FROM m_reconciled m LEFT JOIN (
    SELECT entity_id, 1 AS one, type, event_date FROM r_conditions JOIN m_reconciled USING (entity_id)
    WHERE event_date >= entry_date
      AND event_date < least(adj_death_date, adj_recovery_date, coalesce(progression_date, {STUDY_END}))
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_date, name, code) = 1
  ) o USING (entity_id)"""
CTES["m_master"] = f"""
  SELECT m.*, coalesce(o.one, 0) AS post_onset, coalesce(o.type, 'None') AS post_onset_type,
    o.event_date AS post_onset_date
  FROM m_onset1 m LEFT JOIN (
    SELECT entity_id, 1 AS one, type, event_date FROM r_conditions JOIN m_reconciled USING (entity_id)
    WHERE progression_date <> {STUDY_END} AND event_date >= progression_date
      AND event_date <= least(adj_death_date, adj_recovery_date, {STUDY_END})
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_date, name, code) = 1
  ) o USING (entity_id)"""
CTES["c_numbered"] = """
  SELECT *, row_number() OVER (PARTITION BY cohort_year, sex, age_band, progressed
    ORDER BY md5(CAST(entity_id AS VARCHAR)), entity_id) AS no FROM m_master"""
CTES["c_sizes"] = """
  SELECT cohort_year, sex, age_band, count(*) AS cases FROM m_master WHERE progressed = 1 GROUP BY ALL"""
CTES["c_matched"] = """
  SELECT * EXCLUDE (no), entity_id AS subclass, 0 AS match_no FROM c_numbered WHERE progressed = 1
  UNION ALL
  SELECT m.* EXCLUDE (no), c.entity_id AS subclass, CAST((m.no - 1) // s.cases + 1 AS INTEGER) AS match_no
  FROM c_numbered m JOIN c_sizes s
      ON s.cohort_year = m.cohort_year AND s.sex = m.sex AND s.age_band = m.age_band
    JOIN c_numbered c ON c.progressed = 1 AND c.cohort_year = m.cohort_year AND c.sex = m.sex
      AND c.age_band = m.age_band AND c.no = (m.no - 1) % s.cases + 1
  WHERE m.progressed = 0 AND (m.no - 1) // s.cases < 4"""
CTES["c_shared"] = """
  SELECT m.* EXCLUDE (progression_date), greatest(c.progression_date, m.entry_date) AS progression_date
  FROM c_matched m LEFT JOIN (SELECT cohort_year, subclass, progression_date FROM c_matched WHERE progressed = 1) c
    USING (cohort_year, subclass)"""
CTES["c_indexed"] = """
  SELECT * EXCLUDE (progression_date, follow_up_days), progression_date AS index_date,
    follow_up_end - progression_date + 1 AS follow_up_days FROM c_shared"""
CTES["c_before"] = """
  SELECT m.*, coalesce(b.somatic, 0) AS before_somatic, coalesce(b.mental, 0) AS before_mental,
    greatest(coalesce(b.somatic, 0), coalesce(b.mental, 0)) AS before_any,
    CASE WHEN greatest(coalesce(b.somatic, 0), coalesce(b.mental, 0)) > baseline_any THEN 1 ELSE 0 END AS comorbid
  FROM c_indexed m LEFT JOIN (
    SELECT entity_id, max(CASE WHEN type = 'Somatic' THEN 1 ELSE 0 END) AS somatic,
      max(CASE WHEN type = 'Mental' THEN 1 ELSE 0 END) AS mental
    FROM r_conditions JOIN c_indexed USING (entity_id) WHERE event_date < index_date GROUP BY entity_id
  ) b USING (entity_id)"""
CTES["c_flagged"] = """
  SELECT m.*, CASE WHEN entity_id IN (
      SELECT entity_id FROM r_conditions JOIN c_indexed USING (entity_id)
      WHERE event_date BETWEEN index_date AND follow_up_end) THEN 1 ELSE 0 END AS new_condition FROM c_before m"""
CTES["c_ed"] = f"""
  SELECT entity_id, count(*) AS ed_episodes, count(*) * {cost.ED_PRICE} AS ed_cost FROM (
    SELECT DISTINCT v.* FROM r_ed v JOIN c_indexed m USING (entity_id)
    WHERE attend_date BETWEEN index_date AND follow_up_end) d GROUP BY entity_id"""
CTES["c_stay_days"] = """
  SELECT entity_id, 1.0 - (greatest(index_date - admit_date + 1, 0) + greatest(discharge_date - follow_up_end + 1, 0))
      ::DOUBLE / (discharge_date - admit_date + 1)::DOUBLE AS share,
    coalesce(try_cast(los_acute AS DOUBLE), 0) + coalesce(try_cast(los_convalescent AS DOUBLE), 0) AS general,
    coalesce(try_cast(los_high AS DOUBLE), 0) AS high, coalesce(try_cast(los_icu AS DOUBLE), 0) AS icu,
    coalesce(try_cast(los_psy AS DOUBLE), 0) AS psy
  FROM (SELECT * FROM r_stays QUALIFY row_number() OVER (PARTITION BY entity_id, admit_date, discharge_date ORDER BY
      los_acute NULLS LAST, los_convalescent NULLS LAST, los_high NULLS LAST, los_icu NULLS LAST,
      los_psy NULLS LAST) = 1) s
    JOIN c_indexed m USING (entity_id)
  WHERE admit_date <= follow_up_end AND discharge_date >= index_date"""
CTES["c_stay_sums"] = """
  SELECT entity_id, sum(general * share) AS los_general, sum(high * share) AS los_high, sum(icu * share) AS los_icu,
    sum(psy * share) AS los_psy FROM c_stay_days GROUP BY entity_id"""
CTES["c_ip"] = """
  SELECT *, los_general + los_high + los_icu + los_psy AS los_total, los_general * 5100 AS ip_general_cost,
    los_high * 13650 AS ip_high_cost, los_icu * 24400 AS ip_icu_cost, los_psy * 2340 AS ip_psy_cost,
    los_general * 5100 + los_high * 13650 + los_icu * 24400 + los_psy * 2340 AS ip_cost FROM c_stay_sums"""
CTES["c_services"] = """
  SELECT DISTINCT s.* FROM r_services s JOIN c_indexed m USING (entity_id)
  WHERE visit_date BETWEEN index_date AND follow_up_end"""


def _rx(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, '{pattern}'), false)"


def _codes(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_P = cost.SERVICE_PATTERNS
SERVICE_SQL = {
    "pdh": _rx("service_type", _P["pdh"]),
    "gdh": _rx("service_type", _P["gdh"]),
    "rdh": _rx("service_type", _P["rdh"]),
    "gopc": f"({_rx('service_group', _P['gopc'])} OR {_rx('specialty', _P['gopc_specialty'])}) "
            f"AND NOT {_rx('service_group', _P['injection'])}",
    "sopc_gen": f"{_rx('service_group', _P['sopc_gen'])} AND eis_specialty <> 'PSY'",
    "sopc_psy": f"{_rx('service_group', _P['sopc_psy'])} AND eis_specialty = 'PSY'",
    "sopc_ah": _rx("service_type", _P["sopc_ah"]),
    "com_gen": f"({_rx('service_type', _P['com_gen'])} OR (service_group = '{cost.COMMUNITY}' AND specialty IN "
               f"({_codes(cost.COMMUNITY_GENERAL)}))) AND NOT {_rx('sub_specialty', _P['com_gen_excluded'])}",
    "com_psy": f"{_rx('service_group', _P['com_psy'])} OR (service_group = '{cost.COMMUNITY}' AND specialty IN "
               f"({_codes(cost.COMMUNITY_PSYCHIATRIC)}))",
    "com_ah": f"{_rx('service_type', _P['com_ah'])} OR (service_group = '{cost.COMMUNITY}' AND sub_specialty IN "
              f"({_codes(cost.COMMUNITY_ALLIED)}))",
    "injection": _rx("service_group", _P["injection"]),
}
CTES["c_op"] = "SELECT entity_id, " + ", ".join(
    f"count(DISTINCT visit_date) FILTER ({rule}) AS {name}_episodes, "
    f"count(DISTINCT visit_date) FILTER ({rule}) * {cost.SERVICE_PRICES[name]} AS {name}_cost"
    for name, rule in SERVICE_SQL.items()
) + " FROM c_services GROUP BY entity_id"
_OP = list(SERVICE_SQL)
_IP = ["los_general", "los_high", "los_icu", "los_psy", "los_total", "ip_general_cost", "ip_high_cost", "ip_icu_cost",
       "ip_psy_cost", "ip_cost"]
CTES["c_attached"] = (
    "SELECT m.*, coalesce(ed_episodes, 0) AS ed_episodes, coalesce(ed_cost, 0) AS ed_cost, "
    + ", ".join(f"coalesce(i.{c}, 0) AS {c}" for c in _IP) + ", "
    + ", ".join(f"coalesce({c}_episodes, 0) AS {c}_episodes, coalesce({c}_cost, 0) AS {c}_cost" for c in _OP)
    + " FROM c_flagged m LEFT JOIN c_ed USING (entity_id) LEFT JOIN c_ip i USING (entity_id)"
    " LEFT JOIN c_op USING (entity_id)"
)
CTES["c_totals"] = (
    f"SELECT *, {' + '.join(f'{c}_episodes' for c in _OP)} AS op_episodes, {' + '.join(f'{c}_cost' for c in _OP)} "
    "AS op_cost, sopc_psy_cost + pdh_cost + com_psy_cost AS op_psy_cost FROM c_attached"
)
CTES["c_costed"] = """
  SELECT *, ed_cost + ip_cost + op_cost AS overall_cost, ip_psy_cost + op_psy_cost AS overall_psy_cost FROM c_totals"""
CTES["c_rates"] = "SELECT *, " + ", ".join(
    f"{c} / (follow_up_days / 365.25::DOUBLE) AS {c}_py" for c in cost.RATE_COLUMNS
) + " FROM c_costed WHERE follow_up_days > 0"
CTES["k_people"] = f"""
  SELECT entity_id, CAST(year(first_date) AS INTEGER) AS cohort,
    CASE WHEN age <= 24 THEN 0 WHEN age <= 40 THEN 1 WHEN age <= 65 THEN 2 ELSE 3 END
    + CASE WHEN c_acctbal < 5000 THEN 4 ELSE 0 END + CASE WHEN sex = 'M' THEN 8 ELSE 0 END AS subgroup
  FROM (SELECT f.*, c_acctbal, sex, {_sql_years('birth_date', 'first_date')} AS age
    FROM (SELECT entity_id, min(event_date) AS first_date FROM r_index GROUP BY entity_id) f
    JOIN r_entities USING (entity_id) JOIN customer ON c_custkey = f.entity_id) a"""
CTES["k_incidence"] = "SELECT cohort, count(*) AS incidence FROM k_people GROUP BY cohort"
CTES["k_weights"] = """
  SELECT subgroup, count(*) / (SELECT count(*) FROM k_people)::DOUBLE AS weight FROM k_people GROUP BY subgroup"""
CTES["k_counts"] = "SELECT subgroup, CAST(l_partkey % 10 AS INTEGER) AS t, " + ", ".join(
    f"count(*) FILTER (l_suppkey % 16 = {i}) + 1 AS n{i}" for i in range(16)
) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN k_people ON entity_id = o_custkey GROUP BY 1, 2"
CTES["k_blocks"] = "SELECT subgroup, t, " + ", ".join(
    f"n{i} / ({' + '.join(f'n{j}' for j in targets.values())})::DOUBLE AS p{i}"
    for i, targets in sorted(
        ((i, targets) for targets in markov.TRANSITIONS.values() for i in targets.values()), key=lambda x: x[0]
    )
) + " FROM k_counts"
CTES["k_params"] = """
  SELECT subgroup, t, CAST(replace(name, 'p', '') AS INTEGER) AS ix, p
  FROM (UNPIVOT k_blocks ON COLUMNS('^p[0-9]+$') INTO NAME name VALUE p) u"""
CTES["k_costs"] = f"""
  SELECT {_sql_pick(markov.STATES[:4], 'o_orderkey')} AS state, subgroup, round(avg(o_totalprice), 2) AS cost
  FROM orders JOIN k_people ON entity_id = o_custkey GROUP BY 1, 2"""
CTES["k_start"] = """
  SELECT cohort, subgroup, incidence * weight AS s0, 0::DOUBLE AS s1, 0::DOUBLE AS s2, 0::DOUBLE AS s3,
    0::DOUBLE AS s4, 0::DOUBLE AS s5 FROM k_incidence, k_weights"""
CTES["k_path"] = """
  SELECT cohort, subgroup, 0 AS t, s0, s1, s2, s3, s4, s5 FROM k_start
  UNION ALL
  SELECT k.cohort, k.subgroup, k.t + 1, s0 * p4, s0 * p1 + s1 * p12, s0 * p0 + s1 * p9 + s2 * p8, s2 * p5 + s3 * p15,
    s0 * p2 + s1 * p10 + s2 * p6 + s3 * p13 + s4, s0 * p3 + s1 * p11 + s2 * p7 + s3 * p14 + s5
  FROM k_path k JOIN k_blocks b ON b.subgroup = k.subgroup AND b.t = k.t WHERE k.t < 10"""
CTES["k_occupancy"] = " UNION ALL ".join(
    f"SELECT cohort, subgroup, t, '{s}' AS state, s{i} AS occupancy FROM k_path" for i, s in enumerate(markov.STATES)
)
CTES["k_cost"] = """
  SELECT o.cohort, o.subgroup, o.t, sum(o.occupancy * coalesce(c.cost, 0)) AS cost
  FROM k_occupancy o LEFT JOIN k_costs c USING (state, subgroup) GROUP BY ALL"""
CTES["k_cohort_cost"] = "SELECT cohort, t, sum(cost) AS cost FROM k_cost WHERE t >= 1 GROUP BY cohort, t"
