"""Scans, projections, filters, joins, aggregates and scalar functions over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger import functions as fx
from lifeledger import sources
from lifeledger.operators import aggregates as agg
from lifeledger.operators import relational as rel
from lifeledger.operators.tables import baseline_table, baseline_tests
from lifeledger.plans.registry import query
from lifeledger.plans.roles import Tables
from lifeledger.session import new_path

# Sources and sinks


@query("SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier")
def scan_merge(t: Tables) -> DataFrame:
    return sources.read_extract(t.spark, [t.path("customer"), t.path("supplier")])


@query("""SELECT o_orderkey AS order_key, o_custkey AS customer_key_long_, CAST(o_orderdate AS DATE) AS order_date_yyyy_mm_dd_
          FROM orders""")
def normalize_header(t: Tables) -> DataFrame:
    raw = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return sources.normalize_columns(raw.toDF("Order.Key", "Customer Key (long)", "Order date..(yyyy-mm-dd)."))


@query("""SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS extract_year FROM orders
          WHERE year(o_orderdate) IN (1996, 1997)""")
def scan_subset(t: Tables) -> DataFrame:
    yearly = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("extract_year"))
    path = sources.save_table(yearly, "orders_by_year", partition_by=["extract_year"])
    return sources.read_extract(t.spark, [path], years=[1996, 1997])


@query("""SELECT c_custkey AS party_key, c_name AS party_name, c_nationkey AS nation_key, 'customer' AS kind FROM customer
          UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'supplier' FROM supplier""")
def align_layout(t: Tables) -> DataFrame:
    customers = sources.align(t.customer, {
        "party_key": "c_custkey", "party_name": "c_name", "nation_key": "c_nationkey", "kind": F.lit("customer")})
    suppliers = sources.align(t.read("supplier"), {
        "kind": F.lit("supplier"), "nation_key": "s_nationkey", "party_key": "s_suppkey", "party_name": "s_name"})
    return rel.stack([customers, suppliers])


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
          FROM orders GROUP BY ALL""")
def table_store(t: Tables) -> DataFrame:
    prepared = t.orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sources.load_table(t.spark, sources.save_table(prepared, "prepared"))


@query("SELECT * FROM k_params", name="load_param_blocks")
def load_param_blocks(t: Tables) -> DataFrame:
    return sources.load_markov_params(t.probability_blocks)


@query("""WITH v AS (SELECT o_orderkey % 64 AS position, max(o_totalprice) AS cost FROM orders GROUP BY 1)
          SELECT CASE WHEN position < 16 THEN 0 WHEN position < 32 THEN 2 WHEN position < 48 THEN 1 ELSE 3 END AS state,
            CAST(position % 16 AS INTEGER) AS subgroup, cost FROM v
          UNION ALL SELECT CAST(s AS INTEGER), CAST(g AS INTEGER), 0 FROM range(4, 6) a(s), range(16) b(g)""")
def load_state_costs(t: Tables) -> DataFrame:
    vector = t.orders.groupBy((F.col("o_orderkey") % 64).alias("position")).agg(F.max("o_totalprice").alias("cost"))
    return sources.load_state_costs(vector, 16)


@query("""SELECT p_brand, p_type, count(*) AS n, min(p_size) AS smallest FROM part GROUP BY ALL""")
def load_lookup(t: Tables) -> DataFrame:
    codes = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("smallest"))
    path = sources.write_csv(codes, new_path(t.spark, "lookup"))
    return sources.read_lookup(t.spark, path, "p_brand string, p_type string, n long, smallest int")


@query("SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def write_result(t: Tables) -> DataFrame:
    result = t.read("nation").join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("customers"))
    path = sources.write_csv(result, new_path(t.spark, "result"))
    return t.spark.read.schema("n_name string, customers long").option("header", "true").csv(path)


# Projections and filters


@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def project(t: Tables) -> DataFrame:
    return rel.project(t.lineitem, ["l_orderkey", "l_quantity", "l_returnflag"])


@query("SELECT p_partkey AS part_id, p_brand AS brand, p_type FROM part")
def rename(t: Tables) -> DataFrame:
    return rel.rename(t.part.select("p_partkey", "p_brand", "p_type"), {"p_partkey": "part_id", "p_brand": "brand"})


@query("""SELECT l_orderkey, l_linenumber, round(net, 6) AS net, round(net * (1 + l_tax), 6) AS gross,
            CASE WHEN net * (1 + l_tax) > 50000 THEN 1 ELSE 0 END AS large
          FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) l""")
def derive(t: Tables) -> DataFrame:
    steps = [
        ("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        ("gross", F.col("net") * (1 + F.col("l_tax"))),
        ("large", fx.if_else(F.col("gross") > 50000, 1, 0)),
    ]
    return rel.derive(t.lineitem, steps).select(
        "l_orderkey", "l_linenumber", F.round("net", 6).alias("net"), F.round("gross", 6).alias("gross"), "large")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
          WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def date_window_filter(t: Tables) -> DataFrame:
    return rel.date_window(t.orders, "o_orderdate", F.lit("1996-01-01").cast("date"),
                           F.lit("1996-12-31").cast("date")).select("o_orderkey", "o_orderdate")


@query("""SELECT o_orderkey, o_custkey FROM orders
          WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def membership_filter(t: Tables) -> DataFrame:
    keys = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return rel.in_keys(t.orders.select("o_orderkey", "o_custkey"), keys, "o_custkey")


# Nulls in the tested column show what an exclusion does with them.
_CODED = "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand || '.' || p_type END AS code FROM part"


def _coded(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") > 5, F.concat_ws(".", "p_brand", "p_type")).alias("code"))


@query(f"SELECT * FROM ({_CODED}) p WHERE regexp_matches(code, 'Brand#1|SMALL$')")
def regex_filter(t: Tables) -> DataFrame:
    return rel.matching_rows(_coded(t), "code", ["Brand#1", "SMALL$"])


@query(f"SELECT * FROM ({_CODED}) p WHERE code IS NULL OR NOT regexp_matches(code, 'PROMO|^Brand#2')")
def regex_exclude(t: Tables) -> DataFrame:
    return _coded(t).where(fx.excludes_pattern(F.col("code"), "PROMO|^Brand#2"))


@query("""SELECT p_partkey, p_type, p_brand FROM part WHERE regexp_matches(p_type, '^PROMO$|^ECO')
            OR (p_type = 'SMALL' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))""")
def compound_predicate(t: Tables) -> DataFrame:
    small = (F.col("p_type") == "SMALL") & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")
    return t.part.where(rel.any_rule(F.col("p_type").rlike("^PROMO$|^ECO"), small)).select("p_partkey", "p_type", "p_brand")


@query("""SELECT entity_id, event_date, code FROM r_dx
          WHERE regexp_matches(code, (SELECT string_agg(pattern, '|') FROM r_codes))""")
def pattern_from_table(t: Tables) -> DataFrame:
    pattern = rel.pattern_from_table(t.code_table, "pattern")
    return t.diagnoses.where(fx.contains_pattern(F.col("code"), pattern))


@query("""SELECT entity_id, attend_date, dx_1, dx_2, CASE WHEN regexp_matches(concat_ws(' ', coalesce(dx_1, 'NA'),
            coalesce(dx_2, 'NA'), coalesce(dx_3, 'NA')), 'Brand#3.|L.Brand#1') THEN 1 ELSE 0 END AS joined,
            CASE WHEN coalesce(regexp_matches(dx_1, 'Brand#3.'), false) OR coalesce(regexp_matches(dx_2, 'Brand#3.'), false)
              OR coalesce(regexp_matches(dx_3, 'Brand#3.'), false) THEN 1 ELSE 0 END AS strict FROM r_ed""")
def any_column_match(t: Tables) -> DataFrame:
    columns = [F.col(c) for c in ("dx_1", "dx_2", "dx_3")]
    # The second alternative reaches over the blank between two neighbouring columns.
    return t.ed_visits.select(
        "entity_id", "attend_date", "dx_1", "dx_2",
        fx.any_column_matches(columns, "Brand#3.|L.Brand#1").cast("int").alias("joined"),
        fx.any_column_matches(columns, "Brand#3.", strict=True).cast("int").alias("strict"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def head_preview(t: Tables) -> DataFrame:
    ordered = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.head_preview(ordered, [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("""SELECT l_orderkey, count(DISTINCT l_shipdate) AS n_values FROM lineitem GROUP BY l_orderkey
          HAVING count(DISTINCT l_shipdate) > 1""")
def dedupe_check(t: Tables) -> DataFrame:
    return rel.conflicting_keys(t.lineitem, "l_orderkey", "l_shipdate")


# Joins


@query("""SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey""")
def inner_equi(t: Tables) -> DataFrame:
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rel.inner(t.orders, names, "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT c_custkey, coalesce(n, 0) AS n_urgent, coalesce(spent, 0) AS spent FROM customer LEFT JOIN (
            SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders
            WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def left_equi(t: Tables) -> DataFrame:
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_urgent"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return rel.left_fill(t.customer.select("c_custkey"), urgent, "c_custkey", {"n_urgent": 0, "spent": 0.0})


@query("""SELECT c_nationkey AS nation_key, c_custkey, s_suppkey FROM customer JOIN (
            SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey) s
            ON s_nationkey = c_nationkey""")
def natural_join(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_nationkey").alias("nation_key"), "c_custkey")
    suppliers = t.read("supplier").groupBy(F.col("s_nationkey").alias("nation_key")).agg(
        F.min("s_suppkey").alias("s_suppkey"))
    return rel.natural_join(customers, suppliers)


@query("""SELECT c_custkey, c_name, total AS c_acctbal, segment AS c_mktsegment FROM customer JOIN (
            SELECT o_custkey, round(sum(o_totalprice), 2) AS total, max(o_orderpriority) AS segment FROM orders
            GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def overwrite_join(t: Tables) -> DataFrame:
    newer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"), F.max("o_orderpriority").alias("c_mktsegment"))
    old = t.customer.drop("c_nationkey")
    return rel.overwrite(old, newer, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("""SELECT d.entity_id, d.event_date, d.code, c.pattern, c.name, c.type
          FROM r_dx d LEFT JOIN r_codes c ON regexp_matches(d.code, c.pattern)""")
def regex_theta_join(t: Tables) -> DataFrame:
    return rel.regex_join(t.diagnoses, "code", t.code_table, "pattern")


@query("""SELECT entity_id,
            CASE WHEN entity_id IN (SELECT entity_id FROM r_incident) THEN 1 ELSE 0 END AS incident,
            CASE WHEN entity_id IN (SELECT entity_id FROM r_progression) THEN 1 ELSE 0 END AS progressed
          FROM r_entities""")
def existence_flag(t: Tables) -> DataFrame:
    return rel.flag_if_in(t.entities.select("entity_id"), "entity_id",
                          {"incident": t.incident_keys, "progressed": t.progression_dates})


_WINDOW_SQL = """SELECT entity_id, order_date, ship_date, first_date FROM r_lines JOIN (
    SELECT entity_id, min(event_date) AS first_date FROM r_index GROUP BY entity_id) f USING (entity_id)
  WHERE ship_date >= first_date AND ship_date <= first_date + 365"""


@query(_WINDOW_SQL)
def equi_plus_date_range_join(t: Tables) -> DataFrame:
    windows = t.index_records.groupBy("entity_id").agg(F.min("event_date").alias("first_date"))
    lines = t.lines.select("entity_id", F.col("o_orderdate").alias("order_date"), F.col("l_shipdate").alias("ship_date"))
    return rel.join_window(lines, windows, "entity_id", "ship_date", F.col("first_date"),
                           F.date_add("first_date", 365), salts=8)


@query("SELECT cohort, subgroup, incidence, round(weight, 8) AS weight FROM k_incidence, k_weights")
def cross_param(t: Tables) -> DataFrame:
    return rel.cross_param(t.incidence, t.weights).withColumn("weight", F.round("weight", 8))


# Aggregates


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return agg.distinct_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey, o_orderpriority FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1""")
def first_per_key(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return agg.first_per_key(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@query("SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS o_orderdate FROM orders GROUP BY o_custkey")
def last_per_key(t: Tables) -> DataFrame:
    return agg.last_per_key(t.orders, ["o_custkey"], "o_orderdate")


@query("""SELECT o_custkey, count(*) AS episodes, CAST(count(*) * 1230 AS BIGINT) AS cost FROM orders
          WHERE o_orderpriority = '2-HIGH' GROUP BY o_custkey""")
def count_per_key_priced(t: Tables) -> DataFrame:
    return agg.count_priced(t.orders.where(F.col("o_orderpriority") == "2-HIGH"), "o_custkey", 1230, "episodes", "cost")


@query("""SELECT l_suppkey, sum(l_quantity) AS l_quantity, round(sum(l_tax), 4) AS l_tax,
            sum(l_quantity) * 5100 AS l_quantity_cost, round(sum(l_tax) * 2340, 4) AS l_tax_cost
          FROM lineitem GROUP BY l_suppkey""")
def sum_per_key(t: Tables) -> DataFrame:
    sums = agg.sum_priced(t.lineitem, "l_suppkey", {"l_quantity": 5100.0, "l_tax": 2340.0})
    return sums.withColumns({c: F.round(c, 4) for c in ("l_tax", "l_tax_cost")})


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity / (days / 365.25::DOUBLE)), 6) AS mean_l_quantity_py,
            round(stddev_samp(l_quantity / (days / 365.25::DOUBLE)), 6) AS sd_l_quantity_py
          FROM (SELECT *, ship_date - order_date + 1 AS days FROM r_lines) l WHERE days > 0 GROUP BY l_returnflag""")
def group_mean_sd_rate(t: Tables) -> DataFrame:
    timed = t.lines.withColumn("days", fx.inclusive_days(F.col("o_orderdate"), F.col("l_shipdate")))
    return agg.rate_summary(timed, ["l_returnflag"], ["l_quantity"], "days", decimals=6)


@query("""SELECT sum(l_quantity) AS sum_l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem""")
def global_sums(t: Tables) -> DataFrame:
    return agg.totals(t.lineitem, ["l_quantity", "l_linenumber"])


@query("""SELECT 'shipped_before_order' AS rule, count(*) FILTER (ship_date < order_date) AS violations FROM r_lines
          UNION ALL SELECT 'no_discount_on_large', count(*) FILTER (l_quantity > 45 AND l_returnflag = 'R') FROM r_lines""")
def consistency_counts(t: Tables) -> DataFrame:
    return agg.count_violations(t.lines, {
        "shipped_before_order": F.col("l_shipdate") < F.col("o_orderdate"),
        "no_discount_on_large": (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"),
    })


@query("SELECT DISTINCT l_partkey FROM lineitem")
def key_set(t: Tables) -> DataFrame:
    return agg.key_set(t.lineitem, "l_partkey")


@query("""SELECT user_id, """ + ", ".join(
    f"max(CASE WHEN event_type = '{e}' THEN 1 ELSE 0 END) AS \"{e}\"" for e in ("click", "error", "purchase", "signup")
) + " FROM events GROUP BY user_id")
def one_hot_max(t: Tables) -> DataFrame:
    return agg.one_hot(t.events, "user_id", "event_type", ["click", "error", "purchase", "signup"])


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_ARMS = "SELECT *, CASE WHEN c_custkey IN (SELECT entity_id FROM r_progression) THEN 1 ELSE 0 END AS arm FROM customer"


def _arms(t: Tables) -> DataFrame:
    flagged = rel.flag_if_in(t.entities.select("entity_id"), "entity_id", {"arm": t.progression_dates})
    return flagged.join(t.customer, F.col("entity_id") == F.col("c_custkey"))


@query(f"""WITH a AS ({_ARMS}),
  n AS (SELECT count(*) FILTER (arm = 0) AS n_0, count(*) FILTER (arm = 1) AS n_1 FROM a),
  m AS (SELECT avg(c_acctbal) FILTER (arm = 0) AS m0, avg(c_acctbal) FILTER (arm = 1) AS m1,
          stddev_samp(c_acctbal) FILTER (arm = 0) AS s0, stddev_samp(c_acctbal) FILTER (arm = 1) AS s1 FROM a),
  k AS (SELECT c_mktsegment AS level, (count(*) FILTER (arm = 0))::DOUBLE AS k0, (count(*) FILTER (arm = 1))::DOUBLE AS k1
        FROM a GROUP BY c_mktsegment),
  p AS (SELECT *, k0 / n_0 AS p0, k1 / n_1 AS p1 FROM k, n)
  SELECT n_0, n_1, 'c_acctbal' AS variable, CAST(NULL AS VARCHAR) AS level, round(m0, 4) AS mean_0, round(m1, 4) AS mean_1,
    round(s0, 4) AS sd_0, round(s1, 4) AS sd_1, NULL::DOUBLE AS count_0, NULL::DOUBLE AS count_1, NULL::DOUBLE AS share_0,
    NULL::DOUBLE AS share_1, round(abs(m0 - m1) / sqrt((s0 * s0 + s1 * s1) / 2), 6) AS smd FROM m, n
  UNION ALL SELECT n_0, n_1, 'c_mktsegment', level, NULL, NULL, NULL, NULL, k0, k1, round(p0, 6), round(p1, 6),
    round(abs(p0 - p1) / sqrt((p0 * (1 - p0) + p1 * (1 - p1)) / 2), 6) FROM p""", name="baseline_table")
def baseline_table_query(t: Tables) -> DataFrame:
    table = baseline_table(_arms(t), "arm", ["c_acctbal"], {"c_mktsegment": _SEGMENTS})
    digits = {"mean_0": 4, "mean_1": 4, "sd_0": 4, "sd_1": 4, "share_0": 6, "share_1": 6, "smd": 6}
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


# The t tail by Simpson's rule over the angle whose tangent is t / sqrt(df); the chi-squared tail for 4 degrees of freedom.
@query(f"""WITH a AS ({_ARMS}),
  m AS (SELECT (count(*) FILTER (arm = 0))::DOUBLE AS n0, (count(*) FILTER (arm = 1))::DOUBLE AS n1,
      avg(c_acctbal) FILTER (arm = 0) AS m0, avg(c_acctbal) FILTER (arm = 1) AS m1,
      stddev_samp(c_acctbal) FILTER (arm = 0) AS s0, stddev_samp(c_acctbal) FILTER (arm = 1) AS s1 FROM a),
  t AS (SELECT n0 + n1 - 2 AS df, (m1 - m0) / sqrt(((n0 - 1) * s0 * s0 + (n1 - 1) * s1 * s1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS t FROM m),
  s AS (SELECT df, t, atan(abs(t) / sqrt(df)) AS low, (pi() / 2 - atan(abs(t) / sqrt(df))) / 20000 AS step FROM t),
  p AS (SELECT df, t, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * step / 3 * sum(
      CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(low + i * step), 0), df - 1)) AS p
    FROM s, range(20001) r(i) GROUP BY df, t, step),
  k AS (SELECT c_mktsegment, (count(*) FILTER (arm = 0))::DOUBLE AS k0, (count(*) FILTER (arm = 1))::DOUBLE AS k1 FROM a GROUP BY c_mktsegment),
  x AS (SELECT sum(pow(k0 - (k0 + k1) * n0 / (n0 + n1), 2) / ((k0 + k1) * n0 / (n0 + n1))
      + pow(k1 - (k0 + k1) * n1 / (n0 + n1), 2) / ((k0 + k1) * n1 / (n0 + n1))) AS x FROM k, m)
  SELECT 'c_acctbal' AS variable, round(t, 6) AS statistic, df, round(p, 6) AS p FROM p
  UNION ALL SELECT 'c_mktsegment', round(x, 6), 4.0, round(exp(-x / 2) * (1 + x / 2), 6) FROM x""", name="baseline_tests")
def baseline_tests_query(t: Tables) -> DataFrame:
    table = baseline_tests(_arms(t), "arm", ["c_acctbal"], {"c_mktsegment": _SEGMENTS})
    return table.withColumns({c: F.round(c, 6) for c in ("statistic", "p")})


# Sorts and set operations


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def custom_level_sort(t: Tables) -> DataFrame:
    rows = t.customer.select("c_mktsegment", "c_custkey", "c_acctbal")
    levels = ["HOUSEHOLD", "BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE"]
    return rel.sort_by_levels(rows, {"c_mktsegment": levels}, then=["c_custkey"])


@query("""SELECT o_orderkey AS record_id, CAST(o_orderdate AS DATE) AS date FROM orders
          UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE) FROM lineitem""")
def union_strict(t: Tables) -> DataFrame:
    placed = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("date"))
    shipped = t.lineitem.select(F.col("l_shipdate").alias("date"), F.col("l_orderkey").alias("record_id"))
    return rel.stack([placed, shipped])


@query("SELECT n_nationkey AS key, n_name, NULL AS r_name FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def union_fill(t: Tables) -> DataFrame:
    nations = t.read("nation").select(F.col("n_nationkey").alias("key"), "n_name")
    regions = t.read("region").select(F.col("r_regionkey").alias("key"), "r_name")
    return rel.stack([nations, regions], fill=True)


# Scalar functions


@query("SELECT o_orderkey, ship_date, order_date, ship_date - order_date + 1 AS days FROM r_lines")
def inclusive_days(t: Tables) -> DataFrame:
    return t.lines.select(
        "o_orderkey", F.col("l_shipdate").alias("ship_date"), F.col("o_orderdate").alias("order_date"),
        fx.inclusive_days(F.col("o_orderdate"), F.col("l_shipdate")).cast("long").alias("days"))


@query("""SELECT o_orderkey, CAST(year(d) - year(birth_date) - CASE WHEN month(d) < month(birth_date)
            OR (month(d) = month(birth_date) AND day(d) < day(birth_date)) THEN 1 ELSE 0 END AS INTEGER) AS age
          FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, birth_date FROM orders
                JOIN r_entities ON entity_id = o_custkey) o""")
def completed_years(t: Tables) -> DataFrame:
    joined = t.orders.join(t.entities, F.col("entity_id") == F.col("o_custkey"))
    return joined.select("o_orderkey", fx.completed_years(F.col("birth_date"), F.col("o_orderdate")).alias("age"))


# Every third text is no date.
_TEXT_DATE = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END
  AS text FROM orders"""


@query(f"SELECT o_orderkey, try_cast(text AS DATE) AS date FROM ({_TEXT_DATE}) o")
def parse_date(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", fx.parse_date(text).alias("date"))


@query("""SELECT event_id, try_cast(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) AS k,
            try_cast(event_type AS DOUBLE) AS bad FROM events""")
def parse_number(t: Tables) -> DataFrame:
    k = F.regexp_replace("props", r'\{"k": |\}', "")
    return t.events.select("event_id", fx.parse_number(k).alias("k"), fx.parse_number(F.col("event_type")).alias("bad"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 180 AS later FROM orders")
def add_days(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", fx.add_days(F.col("o_orderdate"), 180).alias("later"))


@query(f"""SELECT p_partkey, CASE WHEN code IS NULL THEN NULL WHEN code LIKE '%SMALL' THEN 1 ELSE 0 END AS flag
           FROM ({_CODED}) p""")
def if_else(t: Tables) -> DataFrame:
    return _coded(t).select("p_partkey", fx.if_else(F.col("code").endswith("SMALL"), 1, 0).alias("flag"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 24 THEN '10-24' WHEN p_size <= 40 THEN '25-40'
            WHEN p_size <= 65 THEN '41-65' ELSE '65+' END AS band FROM part""")
def band(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fx.age_band(F.col("p_size")).alias("band"))


@query(f"""SELECT p_partkey, coalesce(code, 'none') AS filled, nullif(code, 'Brand#1.SMALL') AS nulled
           FROM ({_CODED}) p""")
def replace_null(t: Tables) -> DataFrame:
    code = F.col("code")
    return _coded(t).select(
        "p_partkey", fx.replace_null(code, "none").alias("filled"), fx.null_if(code, "Brand#1.SMALL").alias("nulled"))


@query("""SELECT o_orderkey, greatest(order_date, ship_date) AS later, least(order_date, ship_date) AS earlier
          FROM r_lines""")
def pair_min_max(t: Tables) -> DataFrame:
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    return t.lines.select("o_orderkey", fx.later(a, b).alias("later"), fx.earlier(a, b).alias("earlier"))


@query(f"SELECT p_partkey, coalesce(regexp_matches(code, 'Brand#1.S'), false) AS hit FROM ({_CODED}) p")
def regex_match(t: Tables) -> DataFrame:
    return _coded(t).select("p_partkey", fx.contains_pattern(F.col("code"), "Brand#1.S").alias("hit"))


@query("""SELECT p_partkey, concat_ws('|', lower(p_brand), p_type) AS joined,
            regexp_replace(p_name, '[aeiou]+', '_', 'g') AS cleaned FROM part""")
def string_clean(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.concat_ws("|", F.lower("p_brand"), "p_type").alias("joined"),
        F.regexp_replace("p_name", "[aeiou]+", "_").alias("cleaned"))


@query("""SELECT o_orderkey, l_linenumber, ship_date, round(l_quantity / nullif((ship_date - order_date) / 365.25::DOUBLE, 0), 6)
            AS rate FROM r_lines""")
def person_year_rate(t: Tables) -> DataFrame:
    days = F.datediff("l_shipdate", "o_orderdate")
    return t.lines.select(
        "o_orderkey", "l_linenumber", F.col("l_shipdate").alias("ship_date"),
        F.round(fx.per_person_year(F.col("l_quantity"), days), 6).alias("rate"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round(exp(l_discount), 6) AS e, round(ln(l_extendedprice), 6) AS l,
            round(l_extendedprice / 7, 3) AS r FROM lineitem""")
def exp_log_round(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.exp("l_discount"), 6).alias("e"),
        F.round(F.log(price), 6).alias("l"), F.round(price / 7, 3).alias("r"))


@query("SELECT o_orderkey, greatest(ship_date - order_date, 0) AS wait FROM r_lines")
def clip_zero(t: Tables) -> DataFrame:
    days = F.datediff("l_shipdate", "o_orderdate").cast("long")
    return t.lines.select("o_orderkey", fx.clip_zero(days).alias("wait"))
