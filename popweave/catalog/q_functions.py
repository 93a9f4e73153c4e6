"""Scalar functions and row-generating operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query
from popweave.catalog.standins import band_sql, case_sql, spot, spot_sql, u_sql
from popweave.functions import bands, geo, ids, label_text, schools
from popweave.functions.labels import count_percent_text
from popweave.functions.seeded import random_int
from popweave.operators import ranks, reshape


@query("fn_01", "SELECT c_custkey, lpad(c_custkey::VARCHAR, 15, '0') AS geoid FROM customer")
def fn_01(t):
    return t.customer.select("c_custkey", ids.zfill_id(F.col("c_custkey").cast("double"), 15).alias("geoid"))


GEO_SQL = "'1000000US' || lpad((o_custkey % 57)::VARCHAR, 2, '0') || lpad((o_custkey % 900)::VARCHAR, 3, '0') || CASE WHEN o_orderkey % 3 > 0 THEN lpad((o_orderkey % 99991)::VARCHAR, 6, '0') ELSE '' END || CASE WHEN o_orderkey % 3 > 1 THEN lpad((o_orderkey % 9999)::VARCHAR, 4, '0') ELSE '' END"


@query("fn_02", f"""
WITH g AS (SELECT o_orderkey, regexp_extract({GEO_SQL}, 'US(.*)$', 1) AS code FROM orders)
SELECT o_orderkey, substr(code, 1, 2) AS state, substr(code, 1, 5) AS county, CASE WHEN length(code) >= 11 THEN substr(code, 1, 11) END AS tract,
  CASE WHEN length(code) >= 12 THEN substr(code, 1, 12) END AS blockgroup, CASE WHEN length(code) >= 15 THEN substr(code, 1, 15) END AS block FROM g""")
def fn_02(t):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    code = F.concat(F.lit("1000000US"), ids.zfill(c % 57, 2), ids.zfill(c % 900, 3),
                    F.when(o % 3 > 0, ids.zfill(o % 99991, 6)).otherwise(""), F.when(o % 3 > 1, ids.zfill(o % 9999, 4)).otherwise(""))
    return t.orders.select("o_orderkey", *[v.alias(k) for k, v in ids.geography_ids(code).items()])


@query("fn_03", """
WITH b AS (SELECT c_custkey, lpad((c_nationkey)::VARCHAR, 2, '0') || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || lpad((c_custkey)::VARCHAR, 6, '0') || '0001' AS id FROM customer)
SELECT c_custkey, id AS block, 'B' || id AS block_str FROM b""")
def fn_03(t):
    block = ids.block_id(F.col("c_nationkey"), F.col("c_custkey") % 1000, F.col("c_custkey"), F.lit(1))
    return t.customer.select("c_custkey", block.alias("block"), F.concat(F.lit("B"), block).alias("block_str"))


@query("fn_04", """
WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'jidod' || l_returnflag || (l_linenumber % 3 + 1) || (l_partkey % 3 + 1) || (l_orderkey % 3 + 1) AS jobidod, l_linestatus FROM lineitem)
SELECT l_orderkey, l_linenumber, jobidod, jobidod || 'jobidac' || l_linestatus AS jobidac,
  row_number() OVER (PARTITION BY jobidod, l_suppkey ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey)), l_orderkey, l_linenumber, l_partkey) AS jobidod_counter FROM j""")
def fn_04(t):
    from popweave.plans.jobs import with_job_ids
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("jobtype"), (F.col("l_linenumber") % 3 + 1).alias("Age"),
                             (F.col("l_partkey") % 3 + 1).alias("Earnings"), (F.col("l_orderkey") % 3 + 1).alias("SuperSector"), "l_linestatus")
    keyed = with_job_ids(rows, ["l_linestatus"])
    out = ranks.random_rank(keyed, ["jobidod", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], out="jobidod_counter")
    return out.select("l_orderkey", "l_linenumber", "jobidod", "jobidac", "jobidod_counter")


@query("fn_05", "SELECT c_custkey, regexp_replace(c_name, '^Customer#', '') AS code FROM customer")
def fn_05(t):
    return t.customer.select("c_custkey", F.regexp_replace("c_name", "^Customer#", "").alias("code"))


# Label texts are built from the parts so that their number grows with the table.
LABEL_SQL = """l AS (SELECT p_partkey, 'Total!!' || CASE WHEN p_partkey % 2 = 0 THEN 'Male' ELSE 'Female' END || '!!' ||
  CASE p_partkey % 6 WHEN 0 THEN 'Under ' || p_size || ' years' WHEN 1 THEN p_size || ' and ' || (p_size + 1) || ' years' WHEN 2 THEN p_size || ' years and over'
  WHEN 3 THEN '$' || p_size || ',000 to $' || (p_size + 4) || ',999' WHEN 4 THEN 'Less than $' || p_size || ',000' ELSE '$' || p_size || ',000 or more' END AS label, p_size FROM part)"""


@query("fn_06", f"""WITH {LABEL_SQL}
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS sex,
  CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN p_size WHEN 2 THEN p_size END AS minageyrs, CASE p_partkey % 6 WHEN 0 THEN p_size - 1 WHEN 1 THEN p_size + 1 WHEN 2 THEN 110 END AS maxageyrs,
  CASE p_partkey % 6 WHEN 3 THEN p_size * 1000 WHEN 4 THEN 0 WHEN 5 THEN p_size * 1000 END AS mindollars,
  CASE p_partkey % 6 WHEN 3 THEN p_size * 1000 + 4999 WHEN 4 THEN p_size * 1000 - 1 WHEN 5 THEN p_size * 1000 + 50000 END AS maxdollars FROM l""")
def fn_06(t):
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    up = lambda k: (F.col("p_size") + k).cast("string")
    text = (F.when(m == 0, F.concat(F.lit("Under "), size, F.lit(" years"))).when(m == 1, F.concat(size, F.lit(" and "), up(1), F.lit(" years")))
            .when(m == 2, F.concat(size, F.lit(" years and over"))).when(m == 3, F.concat(F.lit("$"), size, F.lit(",000 to $"), up(4), F.lit(",999")))
            .when(m == 4, F.concat(F.lit("Less than $"), size, F.lit(",000"))).otherwise(F.concat(F.lit("$"), size, F.lit(",000 or more"))))
    label = F.concat(F.lit("Total!!"), F.when(F.col("p_partkey") % 2 == 0, "Male").otherwise("Female"), F.lit("!!"), text)
    parsed = label_text.parse(label)
    return t.part.select("p_partkey", *[parsed[c].alias(c) for c in ("sex", "minageyrs", "maxageyrs", "mindollars", "maxdollars")])


_KM = "2 * 6371 * asin(sqrt(power(sin((radians(y2) - radians(y1)) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin((radians(x2) - radians(x1)) / 2), 2)))"
OD_SQL = f"""od AS (SELECT o_orderkey, o_custkey, {spot_sql('o_custkey', 37)} AS x1, {spot_sql('o_custkey', 53)} AS y1, {spot_sql('o_orderkey', 71)} AS x2, {spot_sql('o_orderkey', 89)} AS y2 FROM orders)"""


def od_pairs(t):
    return t.orders.select("o_orderkey", "o_custkey", spot(F.col("o_custkey"), 37).alias("x1"), spot(F.col("o_custkey"), 53).alias("y1"),
                           spot(F.col("o_orderkey"), 71).alias("x2"), spot(F.col("o_orderkey"), 89).alias("y2"))


@query("fn_10", f"WITH {OD_SQL} SELECT o_orderkey, round({_KM}, 6) AS km FROM od")
def fn_10(t):
    c = F.col
    return od_pairs(t).select("o_orderkey", F.round(geo.great_circle_km(c("y1"), c("y2"), c("x1"), c("x2")), 6).alias("km"))


@query("fn_11", f"""WITH {OD_SQL}, d AS (SELECT o_orderkey, lpad(o_custkey::VARCHAR, 15, '7') AS home, {_KM} AS km FROM od)
SELECT o_orderkey, CASE WHEN km > 500 THEN substr(home, 1, 2) WHEN km > (SELECT avg(km) FROM d) THEN substr(home, 1, 5) ELSE substr(home, 1, 11) END AS home_coarse FROM d""")
def fn_11(t):
    from popweave.plans.jobs import coarse_home
    c = F.col
    rows = od_pairs(t).select("o_orderkey", F.lpad(c("o_custkey").cast("string"), 15, "7").alias("home"), geo.great_circle_km(c("y1"), c("y2"), c("x1"), c("x2")).alias("km"))
    return coarse_home(rows, "home", "km", "home_coarse").select("o_orderkey", "home_coarse")


@query("fn_12", "SELECT l_orderkey, l_linenumber, 'LINESTRING ( ' || l_partkey || ' ' || l_suppkey || ', ' || l_orderkey || ' ' || l_linenumber || ')' AS line, 'POINT (' || l_partkey || ' ' || l_suppkey || ')' AS point FROM lineitem")
def fn_12(t):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", geo.line_text(c("l_partkey"), c("l_suppkey"), c("l_orderkey"), c("l_linenumber")).alias("line"),
                             geo.point_text(c("l_partkey"), c("l_suppkey")).alias("point"))


@query("fn_13", f"""
WITH b AS (SELECT o_orderkey, (o_orderkey % 50)::BIGINT AS lo, (o_orderkey % 50 + o_custkey % 6)::BIGINT AS hi FROM orders)
SELECT o_orderkey, CASE WHEN lo = hi THEN lo ELSE floor(lo + {u_sql('o_orderkey', 133)} * (hi - lo))::BIGINT END AS randage FROM b""")
def fn_13(t):
    lo = F.col("o_orderkey") % 50
    return t.orders.select("o_orderkey", random_int(lo, lo + F.col("o_custkey") % 6, "o_orderkey", 133).alias("randage"))


INCOME_CASE = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice / 4)::BIGINT END"


def _income():
    return F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 4).cast("bigint"))


@query("fn_14", f"""
WITH b AS (SELECT o_orderkey, {INCOME_CASE} AS inc, (o_custkey % 9)::INT AS n, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS gq, CASE WHEN o_orderkey % 17 = 0 THEN 3 END AS vac FROM orders)
SELECT o_orderkey, CASE WHEN inc IS NULL OR gq > 0 OR coalesce(vac, 0) > 0 THEN NULL WHEN {case_sql('n', bands.POVERTY_LIMIT)} IS NULL THEN NULL WHEN inc < {case_sql('n', bands.POVERTY_LIMIT)} THEN 1 ELSE 0 END AS poverty FROM b""")
def fn_14(t):
    o = F.col("o_orderkey")
    return t.orders.select("o_orderkey", bands.poverty(_income(), (F.col("o_custkey") % 9).cast("int"), F.when(o % 13 == 0, 1).otherwise(0), F.when(o % 17 == 0, 3)).alias("poverty"))


@query("fn_15", f"""
WITH b AS (SELECT o_orderkey, {INCOME_CASE} AS inc, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS gq, CASE WHEN o_orderkey % 17 = 0 THEN 3 END AS vac FROM orders)
SELECT o_orderkey, {band_sql('inc', bands.INCOME_16)} AS incomegroup, CASE WHEN inc IS NULL OR gq > 0 OR coalesce(vac, 0) > 0 THEN 0 ELSE {band_sql('inc', bands.INCOME_5)} END AS hhinc FROM b""")
def fn_15(t):
    o = F.col("o_orderkey")
    return t.orders.select("o_orderkey", bands.band(_income(), bands.INCOME_16).alias("incomegroup"),
                           bands.income_group(_income(), F.when(o % 13 == 0, 1).otherwise(0), F.when(o % 17 == 0, 3)).alias("hhinc"))


_AGE_BANDS = {"agegroupP12": bands.AGE_P12, "agegroupH17": bands.AGE_H17, "agegroupH18": bands.AGE_H18, "agegroupB19037": bands.AGE_B19037, "agegroupP43": bands.AGE_P43}


@query("fn_16", "WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 29 <> 0 THEN l_partkey % 115 END AS age FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(
    f'CASE WHEN age IS NULL THEN 0 ELSE {band_sql("age", b)} END AS "{n}"' for n, b in _AGE_BANDS.items()) + " FROM a")
def fn_16(t):
    age = F.when(F.col("l_partkey") % 29 != 0, F.col("l_partkey") % 115)
    aged = t.lineitem.select("l_orderkey", "l_linenumber", age.alias("age"))
    return aged.select("l_orderkey", "l_linenumber", *[bands.band(F.col("age"), b, 0).alias(n) for n, b in _AGE_BANDS.items()])


@query("fn_17", f"SELECT p_partkey, {band_sql('(p_size % 23)', bands.SUPERSECTOR)} AS supersector FROM part")
def fn_17(t):
    return t.part.select("p_partkey", bands.supersector(F.col("p_size") % 23).alias("supersector"))


@query("fn_18", """
SELECT l_suppkey, count(*) FILTER (l_quantity <= 15) AS "CA01", count(*) FILTER (l_quantity > 15) AS "CA02", count(*) FILTER (l_quantity <= 15) AS "CD00" FROM lineitem GROUP BY 1""")
def fn_18(t):
    from popweave.plans.jobs import with_missing_education
    q = F.col("l_quantity")
    return with_missing_education(t.lineitem.groupBy("l_suppkey").agg(F.count(F.when(q <= 15, 1)).alias("CA01"), F.count(F.when(q > 15, 1)).alias("CA02")))


@query("fn_19", """
WITH n AS (SELECT p_partkey, lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '6') AS naics, p_name FROM part)
SELECT p_partkey, substr(naics, 1, 2) AS "NAICS2D", substr(naics, 1, 4) AS "NAICS4D", CASE WHEN substr(naics, 1, 2) IN ('61', '62', '92') THEN p_name END AS "SIName" FROM n""")
def fn_19(t):
    from popweave.plans.links import industry_columns
    naics = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "6")
    return t.part.select("p_partkey", *[c.alias(n) for n, c in industry_columns(naics, F.col("p_name")).items()])


@query("fn_20", """
WITH a AS (SELECT n_nationkey AS fips, 'S' || n_nationkey AS abbr FROM nation)
SELECT l_orderkey, l_linenumber, abbr, CASE WHEN s_nationkey <> c_nationkey THEN 1 ELSE 0 END AS out_of_state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN a ON c_nationkey = fips""")
def fn_20(t):
    names = t.nation.select(F.col("n_nationkey").alias("fips"), F.concat(F.lit("S"), "n_nationkey").alias("abbr"))
    home = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(names, F.col("c_nationkey") == F.col("fips")).select("o_orderkey", "c_nationkey", "abbr")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(home, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "abbr", F.when(F.col("s_nationkey") != F.col("c_nationkey"), 1).otherwise(0).alias("out_of_state"))


@query("fn_21", """
SELECT event_id, try_cast(list_extract(string_split(trim('[' || user_id || ', ' || event_id || ', ' || user_id * 3 || ']', '[]'), ', '), -1) AS BIGINT) AS last_item FROM events""")
def fn_21(t):
    text = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", "), F.col("event_id").cast("string"), F.lit(", "), (F.col("user_id") * 3).cast("string"), F.lit("]"))
    items = F.split(F.regexp_replace(text, r"[\[\]]", ""), ",\\s*")
    return t.events.select("event_id", F.element_at(items, -1).try_cast("bigint").alias("last_item"))


@query("fn_22", """SELECT event_id, try_cast(regexp_extract(props, ':(.*)}', 1) AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events""")
def fn_22(t):
    return t.events.select("event_id", F.regexp_extract("props", ":(.*)}", 1).try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("fn_23", """
SELECT o_orderkey, '$' || format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS dollars, format('{:,}', o_orderkey) || chr(9) || ' (' || printf('%.1f', o_totalprice / 600000 * 100) || '%)' AS share FROM orders""")
def fn_23(t):
    return t.orders.select("o_orderkey", F.concat(F.lit("$"), F.format_number(F.bround("o_totalprice", 0), 0)).alias("dollars"),
                           count_percent_text(F.col("o_orderkey"), F.col("o_totalprice") / 600000).alias("share"))


@query("fn_24", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_linestatus = 'F' THEN 0 END AS hispan, l_returnflag AS race FROM lineitem""")
def fn_24(t):
    from popweave.plans.jobs import person_columns
    coded = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", 2).otherwise(1).alias("Ethnicity"), F.col("l_returnflag").alias("Race"))
    return person_columns(coded)


_SCHOOL_SQL = "CASE doc_id % 5 WHEN 0 THEN 'AM' WHEN 1 THEN 'AS' WHEN 2 THEN 'HI' WHEN 3 THEN 'BL' ELSE 'WH' END || CASE doc_id % 15 WHEN 0 THEN 'PK' WHEN 13 THEN 'KG' WHEN 14 THEN 'UG' ELSE lpad((doc_id % 15)::VARCHAR, 2, '0') END || CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'M' END || '09'"


@query("fn_25", f"""
WITH v AS (SELECT doc_id, {_SCHOOL_SQL} AS variable FROM documents)
SELECT doc_id, CASE substr(variable, 1, 2) WHEN 'AM' THEN 1 WHEN 'AS' THEN 2 WHEN 'HI' THEN 3 WHEN 'BL' THEN 4 ELSE 5 END AS racecat5, CASE substr(variable, 1, 2) WHEN 'AM' THEN 3 WHEN 'AS' THEN 8 WHEN 'HI' THEN -999 WHEN 'BL' THEN 2 ELSE 1 END AS race,
 CASE WHEN substr(variable, 1, 2) = 'HI' THEN 1 ELSE 0 END AS hispan, CASE WHEN substr(variable, 5, 1) = 'F' THEN 2 ELSE 1 END AS sex,
 CASE WHEN substr(variable, 3, 2) IN ('PK', 'KG', 'UG') THEN substr(variable, 3, 2) ELSE 'G' || substr(variable, 3, 2) END AS gradelevel FROM v""")
def fn_25(t):
    d = F.col("doc_id")
    race = F.element_at(F.array(*map(F.lit, ["AM", "AS", "HI", "BL", "WH"])), (d % 5 + 1).cast("int"))
    grade = F.when(d % 15 == 0, "PK").when(d % 15 == 13, "KG").when(d % 15 == 14, "UG").otherwise(ids.zfill(d % 15, 2))
    code = F.concat(race, grade, F.when(d % 2 == 0, "F").otherwise("M"), F.lit("09"))
    return t.documents.select("doc_id", *[c.alias(n) for n, c in schools.expand_code(code).items()])


@query("fn_26", """
SELECT p_partkey, p_size / 2.0::DOUBLE + p_partkey AS cx, p_size / 4.0::DOUBLE AS cy, true AS is_inside FROM part""")
def fn_26(t):
    x, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    ring = geo.rectangle(x, F.lit(0.0), x + s, s / 2)
    rows = t.part.select("p_partkey", ring.alias("ring")).withColumn("c", geo.ring_centroid(F.col("ring")))
    return rows.select("p_partkey", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), geo.inside(F.col("ring"), F.col("c.x"), F.col("c.y")).alias("is_inside"))


# A block shaped like a C: its centroid lies in the gap.
@query("fn_26_inner", """
SELECT p_partkey, p_partkey + 0.5::DOUBLE * p_size AS x, 1.5::DOUBLE * p_size AS y, true AS is_inside, false AS centroid_inside FROM part""")
def fn_26_inner(t):
    k, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    corners = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 2), (4, 2), (4, 3), (0, 3)]
    ring = F.array(*[geo.point(k + s * a, s * b) for a, b in corners])
    rows = t.part.select("p_partkey", F.array(ring).alias("rings"), geo.ring_centroid(ring).alias("c")).withColumn("p", geo.inner_point(F.col("rings")))
    held = lambda c: geo.inside_rings(F.col("rings"), F.col(f"{c}.x"), F.col(f"{c}.y"))
    return rows.select("p_partkey", "p.x", "p.y", held("p").alias("is_inside"), held("c").alias("centroid_inside"))


@query("fn_27", "SELECT p_partkey, concat_ws('-', p_partkey, p_brand, p_type) AS bldg_id FROM part")
def fn_27(t):
    return t.part.select("p_partkey", F.concat_ws("-", F.col("p_partkey").cast("string"), "p_brand", "p_type").alias("bldg_id"))


@query("fn_28", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) / 25 AS relative_gap, floor(l_extendedprice / 1000)::BIGINT AS thousands FROM lineitem")
def fn_28(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.abs(F.col("l_quantity") - 25) / 25).alias("relative_gap"), F.floor(F.col("l_extendedprice") / 1000).alias("thousands"))


@query("fn_29", "SELECT doc_id, starts_with(text, 'The') AS begins_the FROM documents")
def fn_29(t):
    return t.documents.select("doc_id", F.startswith("text", F.lit("The")).alias("begins_the"))


# --- row-generating operators ------------------------------------------------


@query("ex_01", """
SELECT l_orderkey, l_linenumber, l_partkey, unnest(range(1, l_quantity::BIGINT + 1)) AS copy FROM lineitem""")
def ex_01(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("n"))
    return reshape.expand_rows(rows, "n", "copy")


@query("ex_02", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity::BIGINT - 20 AS n, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS present FROM lineitem),
c AS (SELECT *, CASE WHEN n < 0 THEN 1 ELSE n END AS m FROM b),
d AS (SELECT *, CASE WHEN m < present THEN 1 WHEN present = 1 THEN m WHEN m > present THEN m - present ELSE 1 END AS copies FROM c)
SELECT l_orderkey, l_linenumber, l_suppkey, unnest(range(1, copies + 1)) AS copy FROM d""")
def ex_02(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", (F.col("l_quantity").cast("bigint") - 20).alias("n"))
    counted = reshape.job_expand_count(rows, ["l_orderkey", "l_returnflag"], "n")
    return reshape.expand_rows(counted.drop("n", "l_returnflag"), "copies", "copy")


@query("ex_03", """
SELECT o_custkey, unnest(range(1, n + 1)) AS copy, 1 AS jobs FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def ex_03(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return reshape.expand_rows(counts, "n", "copy").withColumn("jobs", F.lit(1))


@query("ex_04", """
SELECT p_partkey, unnest(range(1, greatest(p_size - 25, 1)::BIGINT + 1)) AS copy FROM part""")
def ex_04(t):
    units = F.greatest(F.col("p_size") - 25, F.lit(1)).alias("n")
    return reshape.expand_rows(t.part.select("p_partkey", units), "n", "copy")


@query("ex_05", """
SELECT o_orderkey, unnest(range(1, o_custkey % 8 + 1)) AS pernum FROM orders""")
def ex_05(t):
    return reshape.expand_rows(t.orders.select("o_orderkey", (F.col("o_custkey") % 8).alias("n")), "n", "pernum")
