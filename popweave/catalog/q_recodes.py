"""Projections, filters, predicates and recodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query
from popweave.catalog.standins import band_sql, case_sql
from popweave.functions import bands, labels
from popweave.operators import recode
from popweave.operators.groups import with_group_stats


@query("prj_01", """
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def prj_01(t):
    wanted = t.supplier.filter("s_acctbal > 5000")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return recode.keep_listed(rows, "l_suppkey", wanted, "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("prj_02", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) THEN 1 ELSE 0 END AS match_1,
  CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 1 ELSE 0 END AS match_2
FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)
   OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def prj_02(t):
    return recode.keep_either(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        ("l_partkey", t.part.filter("p_size > 40").select("p_partkey")),
        ("l_suppkey", t.supplier.filter("s_acctbal < 0").select("s_suppkey")),
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "match_1", "match_2")


@query("prj_03", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax <> 0")
def prj_03(t):
    return t.lineitem.filter(F.col("l_tax") != 0).select("l_orderkey", "l_linenumber", "l_tax")


@query("prj_04", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'""")
def prj_04(t):
    conditions = {
        "settled": "o_orderstatus = 'F' OR o_orderstatus = 'O'",
        "large": "o_totalprice > 100000",
        "not low": "o_orderpriority <> '5-LOW'",
    }
    return t.orders.filter(labels.all_of(conditions)).select("o_orderkey", "o_totalprice")


DISCOUNT_RULES = [(1, "> 0", "any"), (2, "> 0.02", "small"), (3, "> 0.04", "medium"), (4, "> 0.06", "large")]


@query("prj_05", """
SELECT l_orderkey, l_linenumber, l_discount,
  CASE WHEN l_discount > 0.06 THEN 4 WHEN l_discount > 0.04 THEN 3 WHEN l_discount > 0.02 THEN 2 WHEN l_discount > 0 THEN 1 END AS discount_int,
  CASE WHEN l_discount > 0.06 THEN 'large' WHEN l_discount > 0.04 THEN 'medium' WHEN l_discount > 0.02 THEN 'small' WHEN l_discount > 0 THEN 'any' END AS discount_str
FROM lineitem""")
def prj_05(t):
    rule = lambda text: F.expr(f"l_discount {text}")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_discount",
        labels.last_match([(rule(r), F.lit(i)) for i, r, _ in DISCOUNT_RULES]).alias("discount_int"),
        labels.last_match([(rule(r), F.lit(s)) for _, r, s in DISCOUNT_RULES]).alias("discount_str"))


@query("prj_06", """
WITH e AS (SELECT o_custkey, count(*) AS expected FROM orders GROUP BY 1),
a AS (SELECT o_custkey, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END) AS estimated FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
b AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS buildings FROM orders WHERE o_orderpriority < '3' GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(expected, 0) = 0 THEN 1 WHEN expected = estimated THEN 2 WHEN expected < estimated THEN 3
  WHEN buildings IS NULL THEN 8 WHEN buildings = 0 THEN 9 WHEN estimated = 0 THEN 5 WHEN expected > estimated THEN 4
  WHEN buildings > 0 THEN 6 ELSE 7 END AS error_code
FROM customer LEFT JOIN e ON c_custkey = e.o_custkey LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN b ON c_custkey = b.o_custkey""")
def prj_06(t):
    # One pass over orders gives all three counts; null where no row qualifies.
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    counts = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("expected"),
        F.sum(F.when(status != "O", F.when(priority.startswith("1"), 2).otherwise(1))).alias("estimated"),
        F.sum(F.when(priority < "3", F.when(status == "O", 1).otherwise(0))).alias("buildings"))
    joined = t.customer.select("c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", labels.block_error_code(F.col("expected"), F.col("estimated"), F.col("buildings")).alias("error_code"))


RETURN_LABELS = {"A": "accepted", "N": "not returned", "R": "returned"}


@query("prj_07", f"""
SELECT l_orderkey, l_linenumber, {case_sql('l_returnflag', RETURN_LABELS)} AS return_label FROM lineitem""")
def prj_07(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.value_label(F.col("l_returnflag"), RETURN_LABELS).alias("return_label"))


RACE_SQL = f"""
WITH c AS (SELECT o_orderkey, (o_orderkey % 8)::VARCHAR AS race,
  CASE WHEN o_custkey % 5 = 0 THEN '1' WHEN o_custkey % 5 = 1 THEN 'x' ELSE '0' END AS hispan,
  CASE WHEN o_orderpriority LIKE '1%' THEN '3' ELSE '0' END AS gqtype FROM orders),
n AS (SELECT o_orderkey, try_cast(race AS INT) AS r, try_cast(hispan AS INT) AS h, try_cast(gqtype AS INT) AS q FROM c)
SELECT o_orderkey, CASE WHEN h = 1 THEN '{labels.ANY_RACE_HISPANIC}'
  WHEN h = 0 AND r BETWEEN 1 AND 7 THEN {case_sql('r', labels.RACE_NOT_HISPANIC)}
  WHEN q >= 1 THEN '{labels.QUARTERS_NO_RACE}' END AS race_ethnicity FROM n"""


@query("prj_08a", RACE_SQL)
def prj_08a(t):
    race = (F.col("o_orderkey") % 8).cast("string")
    hispanic = F.when(F.col("o_custkey") % 5 == 0, "1").when(F.col("o_custkey") % 5 == 1, "x").otherwise("0")
    quarters = F.when(F.col("o_orderpriority").startswith("1"), "3").otherwise("0")
    return t.orders.select("o_orderkey", labels.race_ethnicity(race, hispanic, quarters).alias("race_ethnicity"))


# (key, table, id column, code expression, label table, output)
_VALUE_LABELS = [
    ("prj_08b", "orders", "o_orderkey", "o_orderkey % 9", labels.VACANCY, "vacancy_type"),
    ("prj_08c", "orders", "o_orderkey", "o_custkey % 3", labels.TENURE, "tenure_status"),
    ("prj_08d", "orders", "o_orderkey", "o_custkey % 3", labels.FAMILY, "family_type"),
    ("prj_08g", "part", "p_partkey", "p_size % 22", labels.INDUSTRY, "industry_sector"),
    ("prj_08h", "orders", "o_orderkey", "o_orderkey % 7", labels.INCOME_GROUP, "income_group"),
    ("prj_08i", "orders", "o_orderkey", "o_custkey % 4", labels.POVERTY, "poverty_status"),
    ("prj_08j", "part", "p_partkey", "p_size % 5", labels.JOB_EARNINGS, "job_earnings"),
]


def _register_value_label(key, table, pk, code, names, out):
    @query(key, f"SELECT {pk}, {case_sql('(' + code + ')', names)} AS {out} FROM {table}")
    def labelled(t):
        return getattr(t, table).select(pk, labels.value_label(F.expr(code), names).alias(out))


for _entry in _VALUE_LABELS:
    _register_value_label(*_entry)


@query("prj_08e", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN
  CASE WHEN l_returnflag = 'R' THEN '{labels.DISLOCATION[True]}' ELSE '{labels.DISLOCATION[False]}' END END AS dislocation
FROM lineitem LEFT JOIN (SELECT p_partkey * 2 AS p_partkey FROM part) ON l_partkey = p_partkey""")
def prj_08e(t):
    known = t.part.select((F.col("p_partkey") * 2).alias("p_partkey"))
    joined = t.lineitem.join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber",
                         labels.dislocation(F.col("l_returnflag") == "R", F.col("p_partkey")).alias("dislocation"))


JOB_TYPE_OF = {"A": "JT03", "N": "JT09", "R": "JT99"}


@query("prj_08f", f"""
SELECT l_orderkey, l_linenumber, {case_sql("(" + case_sql('l_returnflag', JOB_TYPE_OF) + ")", labels.JOB_TYPE)} AS job_type FROM lineitem""")
def prj_08f(t):
    job = labels.value_label(F.col("l_returnflag"), JOB_TYPE_OF)
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.value_label(job, labels.JOB_TYPE).alias("job_type"))


@query("prj_09", "SELECT o_orderkey, o_custkey FROM orders")
def prj_09(t):
    return recode.drop_matching(t.orders, prefixes=["o_total"], suffixes=["date", "priority"], parts=["status"])


@query("prj_10", "SELECT s_nationkey, s_suppkey, s_name, s_acctbal FROM supplier")
def prj_10(t):
    return recode.keys_first(t.supplier, ["s_nationkey", "s_suppkey"])


@query("prj_11", """
SELECT 'H' || c_custkey AS huid, lpad(c_nationkey::VARCHAR, 15, '0') AS blockid, substr(lpad(c_nationkey::VARCHAR, 15, '0'), 1, 11) AS tractid,
  (CASE WHEN c_acctbal >= 0 THEN 1 ELSE 2 END)::INT AS ownershp, floor(c_acctbal)::INT AS income, NULL::INT AS vacancy FROM customer""")
def prj_11(t):
    C = recode.OutColumn
    spec = [
        C("huid", "string", "concat('H', c_custkey)"),
        C("blockid", "string", "c_nationkey", 15),
        C("tractid", "string", "substring(lpad(c_nationkey, 15, '0'), 1, 11)"),
        C("ownershp", "int", "case when c_acctbal >= 0 then 1 else 2 end"),
        C("income", "int", "floor(c_acctbal)"),
        C("vacancy", "int"),
    ]
    return recode.conform(t.customer, spec)


@query("prj_12", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT END AS l_quantity_int,
  CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT END AS l_extendedprice_int FROM lineitem""")
def prj_12(t):
    return recode.whole_numbers(t.lineitem, ["l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", "l_quantity_int", "l_extendedprice_int")


@query("prj_13", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 7)::INT END AS s,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 2 END AS q, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v > 0 AND s IS NULL THEN 0 ELSE s END AS numprec,
  CASE WHEN (s > 0 AND q IS NULL AND v IS NULL) OR (v > 0 AND s IS NULL) THEN 0 ELSE q END AS gqtype,
  CASE WHEN s > 0 AND q IS NULL AND v IS NULL THEN 0 WHEN q > 0 AND s IS NOT NULL THEN 0 ELSE v END AS vacancy FROM b""")
def prj_13(t):
    base = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_custkey") % 7).cast("int")).alias("s"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), 2).alias("q"),
        F.when(F.col("o_orderkey") % 5 == 0, 1).alias("v"))
    filled = recode.fill_rules(F.col("s"), F.col("q"), F.col("v"))
    return base.select("o_orderkey", *[c.alias(n) for n, c in filled.items()])


@query("prj_14", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS label FROM part""")
def prj_14(t):
    merged = t.part.select("p_partkey", F.col("p_type").alias("label_x"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("label_y"))
    return recode.prefer_right(merged, ["label"])


@query("prj_15", """
SELECT o_orderkey, coalesce(c_nationkey::VARCHAR, '999999999999999') AS blockid, coalesce('B' || c_nationkey, 'B999999999999999') AS block_str,
  coalesce(c_name, 'Outside County') AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey * 2""")
def prj_15(t):
    inside = t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), "c_nationkey", "c_name")
    joined = t.orders.join(inside, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        "o_orderkey",
        F.coalesce(F.col("c_nationkey").cast("string"), F.lit("9" * 15)).alias("blockid"),
        F.coalesce(F.concat(F.lit("B"), F.col("c_nationkey").cast("string")), F.lit("B" + "9" * 15)).alias("block_str"),
        F.coalesce("c_name", F.lit("Outside County")).alias("place"))


@query("prj_16", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 1 WHEN o_custkey % 4 = 1 THEN 0 WHEN o_custkey % 4 = 2 THEN -999 END AS h,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END AS r FROM orders)
SELECT o_orderkey, CASE WHEN h = 1 THEN 'Hispanic' WHEN h = 0 OR (h = -999 AND r IS NOT NULL) THEN 'not Hispanic'
  ELSE 'no Hispanic data' END AS split_group FROM b""")
def prj_16(t):
    m = F.col("o_custkey") % 4
    hispanic = F.when(m == 0, 1).when(m == 1, 0).when(m == 2, -999)
    race = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7)
    return t.orders.select("o_orderkey", recode.hispanic_split(hispanic, race).alias("split_group"))


@query("prj_17", f"""
SELECT l_orderkey, l_linenumber, {case_sql('l_returnflag', JOB_TYPE_OF)} AS jobtype FROM lineitem""")
def prj_17(t):
    # One table with the job type as a column; a per-type table is a filter on it.
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.value_label(F.col("l_returnflag"), JOB_TYPE_OF).alias("jobtype"))


@query("prj_18", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'open' WHEN p_size % 5 = 1 THEN 'primary' WHEN p_size % 5 = 2 THEN 'middle'
  WHEN p_size % 5 = 3 THEN 'high' ELSE 'other' END AS zone FROM part""")
def prj_18(t):
    level = (F.col("p_size") % 5).cast("string")
    opened = F.when(F.col("p_brand") == "Brand#1", "1").otherwise("0")
    return t.part.select("p_partkey", recode.zone_category(level, opened).alias("zone"))


@query("prj_19", """
SELECT s_suppkey::VARCHAR AS ncesid, s_name AS name, s_nationkey::VARCHAR AS cnty, 'supplier' AS level, 1 AS schtype, '2009' AS schyr FROM supplier
UNION ALL SELECT c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, 'customer', 2, '2009' FROM customer""")
def prj_19(t):
    a = recode.append_ready(t.supplier, {"s_suppkey": "ncesid", "s_name": "name", "s_nationkey": "cnty"},
                            {"level": "supplier", "schtype": 1, "schyr": "2009"})
    b = recode.append_ready(t.customer, {"c_custkey": "ncesid", "c_name": "name", "c_nationkey": "cnty"},
                            {"level": "customer", "schtype": 2, "schyr": "2009"})
    return a.unionByName(b)


@query("prj_20", """
WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'b''' || floor(value)::BIGINT || '''' WHEN 1 THEN '-2' WHEN 2 THEN 'n/a' ELSE floor(value)::BIGINT::VARCHAR END AS raw FROM events),
n AS (SELECT event_id, try_cast(regexp_replace(raw, '^b''|''$', '', 'g') AS INT) AS n FROM b)
SELECT event_id, CASE WHEN n IN (-1, -2, -9) THEN 0 ELSE n END AS clean FROM n""")
def prj_20(t):
    whole = F.floor("value").cast("bigint").cast("string")
    m = F.col("event_id") % 4
    raw = F.when(m == 0, F.concat(F.lit("b'"), whole, F.lit("'"))).when(m == 1, "-2").when(m == 2, "n/a").otherwise(whole)
    return t.events.select("event_id", recode.clean_count(raw).alias("clean"))


@query("prj_21", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN -1 ELSE l_tax END AS l_tax, CASE WHEN l_discount = 0 THEN -1 ELSE l_discount END AS l_discount FROM lineitem""")
def prj_21(t):
    return recode.recode_many(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), ["l_tax", "l_discount"], 0.0, -1.0)


@query("prj_22", """
WITH j AS (SELECT l_orderkey, l_linenumber, p_partkey, s_suppkey, l_linenumber - 1 AS counter, l_quantity,
   CASE WHEN l_returnflag <> 'R' OR l_linestatus = 'O' THEN l_linestatus END AS blk
  FROM lineitem LEFT JOIN (SELECT p_partkey * 2 AS p_partkey FROM part) ON l_partkey = p_partkey
  LEFT JOIN (SELECT s_suppkey * 3 AS s_suppkey FROM supplier) ON l_suppkey = s_suppkey),
f AS (SELECT *, CASE WHEN blk IS NULL THEN 3 WHEN p_partkey IS NULL THEN 2 WHEN s_suppkey IS NULL THEN 1 ELSE 0 END AS flag_ap FROM j)
SELECT l_orderkey, l_linenumber, flag_ap, CASE WHEN counter = 0 AND flag_ap <= 1 THEN 1 ELSE 0 END AS bldgobs,
  CASE WHEN p_partkey IS NULL OR l_quantity > 25 THEN 1 ELSE 0 END AS residential FROM f""")
def prj_22(t):
    joined = (t.lineitem.join(t.part.select((F.col("p_partkey") * 2).alias("p_partkey")), F.col("l_partkey") == F.col("p_partkey"), "left")
              .join(t.supplier.select((F.col("s_suppkey") * 3).alias("s_suppkey")), F.col("l_suppkey") == F.col("s_suppkey"), "left"))
    block = F.when((F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "O"), F.col("l_linestatus"))
    flags = recode.address_flags(F.col("p_partkey"), F.col("s_suppkey"), block, F.col("l_linenumber") - 1, F.col("l_quantity") - 25)
    return joined.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in flags.items()])


@query("prj_23", """
WITH e AS (SELECT p_type AS a, (length(p_type) % 4)::INT AS est FROM part GROUP BY 1, 2),
j AS (SELECT p_partkey, coalesce(est, 0) AS est, p_size * 100.0::DOUBLE AS area FROM part LEFT JOIN e ON p_type = a)
SELECT p_partkey, CASE WHEN area < 500 OR (est > 0 AND area / est < 500) THEN 0 ELSE est END AS units FROM j""")
def prj_23(t):
    archetypes = t.part.select(F.col("p_type").alias("a"), (F.length("p_type") % 4).cast("int").alias("est")).distinct()
    joined = t.part.join(archetypes, F.col("p_type") == F.col("a"), "left")
    return joined.select("p_partkey", recode.archetype_units(F.col("est"), F.col("p_size") * 100.0, 500.0).alias("units"))


@query("prj_24", """
SELECT p_partkey, CASE WHEN p_size % 6 IN (1, 2) THEN 1 ELSE -777 END AS ownershp1, CASE WHEN p_size % 6 > 2 THEN 2 ELSE -777 END AS ownershp2,
  CASE WHEN p_size % 6 > 0 THEN 2 ELSE -777 END AS ownershp3 FROM part""")
def prj_24(t):
    guesses = recode.tenure_guesses(F.col("p_size") % 6)
    return t.part.select("p_partkey", *[c.alias(n) for n, c in guesses.items()])


@query("prj_25", "SELECT p_partkey, CASE WHEN p_size = 1 OR p_type = 'ECONOMY' THEN 1 ELSE 0 END AS d_sf FROM part")
def prj_25(t):
    return t.part.select("p_partkey", F.when((F.col("p_size") == 1) | (F.col("p_type") == "ECONOMY"), 1).otherwise(0).alias("d_sf"))


_WORKER_SQL = f"""
WITH p AS (SELECT o_orderkey, o_custkey, (o_orderkey % 97)::INT AS age FROM orders),
w AS (SELECT o_orderkey, o_custkey, CASE WHEN {band_sql('age', bands.AGE_JOBS)} IN (1, 2, 3) THEN 1 ELSE 0 END AS worker FROM p),
s AS (SELECT o_orderkey, worker, sum(worker) OVER (PARTITION BY o_custkey)::BIGINT AS w1, o_custkey FROM w),
s2 AS (SELECT *, CASE WHEN w1 > 1 THEN w1 - 1 WHEN w1 = 1 THEN 1 ELSE 0 END AS w2 FROM s),
s3 AS (SELECT *, CASE WHEN w2 > 1 THEN w2 - 1 WHEN w2 = 1 THEN 1 ELSE 0 END AS w3 FROM s2),
j AS (SELECT s3.*, round(c_acctbal) * 120 AS inc FROM s3 JOIN customer ON o_custkey = c_custkey),
m AS (SELECT *, CASE WHEN w1 > 0 THEN round_even(inc / w1 / 12, 6) END AS m1, CASE WHEN w2 > 0 THEN round_even(inc / w2 / 12, 6) END AS m2,
   CASE WHEN w3 > 0 THEN round_even(inc / w3 / 12, 6) END AS m3 FROM j)
SELECT o_orderkey, worker, w1 AS workers1, w2 AS workers2, w3 AS workers3,
  CASE WHEN m1 <= 1250 THEN 1 WHEN m1 <= 3333 THEN 2 WHEN m1 > 3333 THEN 3 END AS earnings1,
  CASE WHEN m2 <= 1250 THEN 1 WHEN m2 <= 3333 THEN 2 WHEN m2 > 3333 THEN 3 END AS earnings2,
  CASE WHEN m3 <= 1250 THEN 1 WHEN m3 <= 3333 THEN 2 WHEN m3 > 3333 THEN 3 END AS earnings3 FROM m"""


@query("prj_26", _WORKER_SQL)
def prj_26(t):
    people = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 97).cast("int").alias("age"))
    people = people.withColumn("worker", recode.possible_worker(F.col("age")))
    people = with_group_stats(people, ["o_custkey"], w1=F.sum("worker"))
    joined = people.join(t.customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    cols = recode.worker_columns(F.col("w1"), F.round("c_acctbal") * 120)
    return joined.select("o_orderkey", "worker", *[cols[f"workers{i}"].cast("bigint").alias(f"workers{i}") for i in (1, 2, 3)],
                         *[cols[f"earnings{i}"].alias(f"earnings{i}") for i in (1, 2, 3)])


@query("prj_27", """
WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
  count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 50000) AS p, count(*) AS reported FROM orders GROUP BY 1)
SELECT o_custkey, f + o + p AS row_total, reported - (f + o + p) AS difference, CASE WHEN reported <> f + o + p THEN 1 ELSE 0 END AS discrepancy FROM c""")
def prj_27(t):
    status = F.col("o_orderstatus")
    counts = t.orders.groupBy("o_custkey").agg(
        F.count(F.when(status == "F", 1)).alias("f"), F.count(F.when(status == "O", 1)).alias("o"),
        F.count(F.when((status == "P") & (F.col("o_totalprice") > 50000), 1)).alias("p"), F.count(F.lit(1)).alias("reported"))
    return recode.row_sum_check(counts, ["f", "o", "p"], "reported").select("o_custkey", "row_total", "difference", "discrepancy")


@query("prj_28", """
SELECT l_orderkey, l_linenumber, coalesce(nullif(l_tax, 0), nullif(l_discount, 0), l_quantity) AS first_value FROM lineitem""")
def prj_28(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(
        F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_discount"), F.lit(0.0)), F.col("l_quantity")).alias("first_value"))


@query("prj_29", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 20 THEN 2 WHEN l_quantity > 0 THEN 1 END AS height_class FROM lineitem""")
def prj_29(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.last_match(
        [(q > 0, F.lit(1)), (q > 20, F.lit(2)), (q > 40, F.lit(3))]).alias("height_class"))


@query("prj_31", """
SELECT l_orderkey, l_linenumber, 'JT03' AS jobtype, l_quantity AS jobcount, 'SE02' AS segpart, 2 AS "Earnings" FROM lineitem""")
def prj_31(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return recode.job_columns(rows, "JT03", "l_quantity", "SE02", "SE", "Earnings").drop("l_quantity")


@query("prj_32", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber AS num, (l_orderkey % 2)::INT AS fam, CASE WHEN l_orderkey % 3 = 0 THEN -999 ELSE (l_orderkey % 3)::INT END AS sx,
  CASE WHEN l_orderkey % 7 = 0 THEN 2 ELSE 0 END AS gq, (l_partkey % 9)::INT AS h17, (l_partkey % 3)::INT AS h18 FROM lineitem),
c AS (SELECT *, fam = 1 AND gq = 0 AND ((sx = -999 AND num > 2) OR (sx IN (1, 2) AND num > 1)) AS ch FROM b),
d AS (SELECT *, gq = 0 AND num > 2 AND NOT ch AS oth FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN ch THEN 1 ELSE -999 END AS child, CASE WHEN ch THEN -999 ELSE sx END AS sex,
  CASE WHEN ch OR oth THEN -999 ELSE h17 END AS "agegroupH17", CASE WHEN ch OR oth THEN -999 ELSE h18 END AS "agegroupH18" FROM d""")
def prj_32(t):
    order = F.col("l_orderkey")
    cols = recode.family_resets(
        F.col("l_linenumber"), (order % 2).cast("int"), F.when(order % 3 == 0, -999).otherwise((order % 3).cast("int")),
        F.when(order % 7 == 0, 2).otherwise(0), (F.col("l_partkey") % 9).cast("int"), (F.col("l_partkey") % 3).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


@query("prj_33", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name END AS school_1, CASE WHEN p_size % 4 = 1 THEN p_name END AS school_2,
  CASE WHEN p_size % 4 = 2 THEN p_name END AS school_3, CASE WHEN p_size % 4 = 3 THEN p_name END AS school_4,
  p_type AS gradelevel1, p_type AS gradelevel2, p_type AS gradelevel3 FROM part""")
def prj_33(t):
    level = F.col("p_size") % 4
    return t.part.select("p_partkey", *[F.when(level == i, F.col("p_name")).alias(f"school_{i + 1}") for i in range(4)],
                         *[F.col("p_type").alias(f"gradelevel{i}") for i in (1, 2, 3)])


@query("prj_34", """
SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'linked' ELSE 'not linked' END AS availability
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') ON o_custkey = c_custkey""")
def prj_34(t):
    known = t.customer.filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    joined = t.orders.select("o_orderkey", "o_custkey").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.when(F.col("c_custkey").isNotNull(), "linked").otherwise("not linked").alias("availability"))
