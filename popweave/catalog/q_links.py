"""Students, jobs, establishments and schools linked to persons and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.q_spatial import CUST_SQL, DIST, SUPP_SQL, customer_points, supplier_points
from popweave.catalog.registry import query
from popweave.catalog.standins import LINES_SQL, SLOTS_SQL, UNITS_SQL, cascade_sql, lines, slots, spot, spot_sql, units
from popweave.functions import bands
from popweave.functions.schools import count_columns
from popweave.operators.random_merge import Round, Side, random_merge
from popweave.operators.reshape import expand_rows
from popweave.plans import ensemble, links
from popweave.session import cut

# School counts: suppliers as schools, one count per race, grade and sex code.
_SCHOOL_COLS = count_columns()
_CODE_SQL = """(SELECT l_suppkey AS school, (l_suppkey % 4 + 1)::INT AS level, ['AM', 'AS', 'HI', 'BL', 'WH'][(l_partkey % 5 + 1)::INT] || CASE l_orderkey % 15 WHEN 0 THEN 'PK' WHEN 13 THEN 'KG' WHEN 14 THEN 'UG' ELSE lpad((l_orderkey % 15)::VARCHAR, 2, '0') END
  || CASE WHEN l_linestatus = 'O' THEN 'F' ELSE 'M' END || '09' AS variable FROM lineitem)"""


def school_codes(t):
    race = F.element_at(F.array(*[F.lit(r) for r in ("AM", "AS", "HI", "BL", "WH")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    g = F.col("l_orderkey") % 15
    grade = F.when(g == 0, "PK").when(g == 13, "KG").when(g == 14, "UG").otherwise(F.lpad(g.cast("string"), 2, "0"))
    code = F.concat(race, grade, F.when(F.col("l_linestatus") == "O", "F").otherwise("M"), F.lit("09"))
    return t.lineitem.select(F.col("l_suppkey").alias("school"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("level"), code.alias("variable"))


def school_wide(t):
    counts = school_codes(t).groupBy("school", "level", "variable").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("school", "level").pivot("variable", _SCHOOL_COLS).agg(F.first("n"))


_STUDENT_SQL = f"""c AS (SELECT school, level, variable, unnest(range(1, n + 1)) AS i FROM (SELECT school, level, variable, count(*) AS n FROM {_CODE_SQL} GROUP BY 1, 2, 3)),
k AS (SELECT *, row_number() OVER (PARTITION BY school ORDER BY md5(concat_ws('|', school, variable, i)), concat_ws('|', school, variable, i)) AS srec_counter FROM c)"""


@query("pl_14", f"""WITH {_STUDENT_SQL} SELECT 'S' || school || 'syr20092010c' || lpad(srec_counter::VARCHAR, length((SELECT max(srec_counter) FROM k)::VARCHAR)::INT, '0') AS srecid, CASE substr(variable, 1, 2) WHEN 'AM' THEN 1 WHEN 'AS' THEN 2 WHEN 'HI' THEN 3 WHEN 'BL' THEN 4 ELSE 5 END AS racecat5,
 CASE WHEN substr(variable, 5, 1) = 'F' THEN 2 ELSE 1 END AS sex, CASE WHEN substr(variable, 3, 2) IN ('PK', 'KG', 'UG') THEN substr(variable, 3, 2) ELSE 'G' || substr(variable, 3, 2) END AS gradelevel,
 CASE WHEN level = 1 THEN school END AS ncessch_1, CASE WHEN level = 3 THEN school END AS ncessch_3 FROM k""")
def pl_14(t):
    records = links.student_records(school_wide(t), "school", "level", _SCHOOL_COLS, "20092010")
    return records.select("srecid", "racecat5", "sex", "gradelevel", "ncessch_1", "ncessch_3")


#: Kinds of school zones; a school belongs to one of them.
ZONES = (1, 2, 3, 5, 6)


def _pupils(t):
    """Persons of school age with their school zones and grade guesses."""
    grade = lambda k: F.concat(F.lit("G"), F.lpad(((F.col("o_orderkey") + k) % 12 + 1).cast("string"), 2, "0"))
    schools = t.supplier.agg(F.max("s_suppkey")).scalar() + 1
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    zones = {1: c, 2: c + 1, 3: o, 5: o + 1, 6: c + o}
    return t.orders.select(
        F.col("o_orderkey").alias("precid"), *[(z % schools).alias(f"zone_{i}") for i, z in zones.items()],
        *[grade(k).alias(f"grade_{k + 1}") for k in range(3)], F.when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("p_sex"), (F.col("o_custkey") % 5 + 1).cast("int").alias("p_race"))


def _students_linked(t):
    students = cut(links.student_records(school_wide(t), "school", "level", _SCHOOL_COLS, "20092010").select("srecid", "school", "level", "racecat5", "sex", "gradelevel"), "students")
    home = students.withColumns({f"s_{i}": F.when(F.col("school") % len(ZONES) == k, F.col("school")) for k, i in enumerate(ZONES)})
    grades = [(f"grade {i}", f"grade_{i}", "gradelevel") for i in (1, 2, 3)]
    zones = [(f"zone {i}", f"zone_{i}", f"s_{i}") for i in ZONES]
    slim = home.select("srecid", *[f"s_{i}" for i in ZONES], "racecat5", "sex", "gradelevel")
    return students, links.students_to_persons(Side(_pupils(t), "precid"), Side(slim, "srecid"), zones, grades, ("sex", "p_sex", "sex"), ("race", "p_race", "racecat5"), 133)


_PUPIL_ROUNDS = [([zone, grade, *p], [s, "gradelevel", *b]) for grade in ("grade_1", "grade_2", "grade_3") for zone, s in [(f"zone_{i}", f"s_{i}") for i in ZONES]
                 for p, b in ((["p_sex", "p_race"], ["sex", "racecat5"]), (["p_sex"], ["sex"]), ([], []))]
_PUPIL_CTES, _PUPIL_PAIRS = cascade_sql("pu", "precid", "su", "srecid", _PUPIL_ROUNDS, 133)
_PUPILS_SQL = f"""{_STUDENT_SQL}, su AS MATERIALIZED (SELECT 'S' || school || 'syr20092010c' || lpad(srec_counter::VARCHAR, length((SELECT max(srec_counter) FROM k)::VARCHAR)::INT, '0') AS srecid, CASE substr(variable, 1, 2) WHEN 'AM' THEN 1 WHEN 'AS' THEN 2 WHEN 'HI' THEN 3 WHEN 'BL' THEN 4 ELSE 5 END AS racecat5,
 CASE WHEN substr(variable, 5, 1) = 'F' THEN 2 ELSE 1 END AS sex, CASE WHEN substr(variable, 3, 2) IN ('PK', 'KG', 'UG') THEN substr(variable, 3, 2) ELSE 'G' || substr(variable, 3, 2) END AS gradelevel,
 school, {', '.join(f'CASE WHEN school % 5 = {k} THEN school END AS s_{i}' for k, i in enumerate(ZONES))} FROM k),
pu AS MATERIALIZED (SELECT o_orderkey AS precid, o_custkey % n AS zone_1, (o_custkey + 1) % n AS zone_2, o_orderkey % n AS zone_3, (o_orderkey + 1) % n AS zone_5, (o_custkey + o_orderkey) % n AS zone_6,
 {', '.join(f"'G' || lpad(((o_orderkey + {k}) % 12 + 1)::VARCHAR, 2, '0') AS grade_{k + 1}" for k in range(3))},
 CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS p_sex, o_custkey % 5 + 1 AS p_race FROM orders, (SELECT max(s_suppkey) + 1 AS n FROM supplier))"""


@query("pl_15", f"WITH {_PUPILS_SQL}, {_PUPIL_CTES} {_PUPIL_PAIRS}")
def pl_15(t):
    return _students_linked(t)[1].pairs


# Jobs to persons: order lines as jobs, orders as persons.
_JOB_SQL = f"""{UNITS_SQL}, pe AS MATERIALIZED (SELECT o_orderkey AS precid, block, tract, CASE WHEN o_orderkey % 97 BETWEEN 18 AND 29 THEN 1 WHEN o_orderkey % 97 BETWEEN 30 AND 54 THEN 2 WHEN o_orderkey % 97 BETWEEN 55 AND 65 THEN 3 END AS agegrp, o_orderkey % 2 + 1 AS p_sex,
  o_custkey % 3 + 1 AS earn_1, (o_custkey + 1) % 3 + 1 AS earn_2, (o_custkey + 2) % 3 + 1 AS earn_3, block // 2 AS blockgroup, 1 AS county,
  o_orderkey % 3 + 1 AS p_race, o_custkey % 2 AS p_hispan FROM orders JOIN units ON o_custkey = c_custkey),
jb AS MATERIALIZED (SELECT line_key AS jobid, s_nationkey AS j_block, n_regionkey AS j_tract, l_linenumber % 3 + 1 AS j_age, l_partkey % 2 + 1 AS j_sex, l_suppkey % 3 + 1 AS j_earn, s_nationkey // 2 AS j_blockgroup, 1 AS j_county,
  l_orderkey % 3 + 1 AS j_race, l_partkey % 3 % 2 AS j_hispan FROM {LINES_SQL} JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
_LEVELS = ("block", "blockgroup", "tract", "county")
_JOB_ROUNDS = [([lvl, "agegrp", "p_sex", "p_race", "p_hispan", e], [f"j_{lvl}", "j_age", "j_sex", "j_race", "j_hispan", "j_earn"])
               for e in ("earn_1", "earn_2", "earn_3") for lvl in _LEVELS]
_JOB_CTES, _JOB_PAIRS = cascade_sql("pe", "precid", "jb", "jobid", _JOB_ROUNDS, 133)


def _workers(t):
    o = F.col("o_orderkey")
    people = t.orders.join(units(t), F.col("o_custkey") == F.col("c_custkey"))
    code = bands.band(o % 97, bands.AGE_JOBS)
    return people.select(o.alias("precid"), "block", "tract", F.when(code.isin(1, 2, 3), code).alias("agegrp"), (o % 2 + 1).alias("p_sex"),
                         (F.col("o_custkey") % 3 + 1).alias("earn_1"), ((F.col("o_custkey") + 1) % 3 + 1).alias("earn_2"), ((F.col("o_custkey") + 2) % 3 + 1).alias("earn_3"),
                         F.expr("block div 2").alias("blockgroup"), F.lit(1).alias("county"), (o % 3 + 1).alias("p_race"), (F.col("o_custkey") % 2).alias("p_hispan"))


def _jobs(t):
    at = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    rows = lines(t, ids_only=True, meet="l_suppkey").join(at, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("line_key").alias("jobid"), F.col("s_nationkey").alias("j_block"), F.col("n_regionkey").alias("j_tract"),
                       (F.col("l_linenumber") % 3 + 1).alias("j_age"), (F.col("l_partkey") % 2 + 1).alias("j_sex"), (F.col("l_suppkey") % 3 + 1).alias("j_earn"),
                       F.expr("s_nationkey div 2").alias("j_blockgroup"), F.lit(1).alias("j_county"), (F.col("l_orderkey") % 3 + 1).alias("j_race"), (F.col("l_partkey") % 3 % 2).alias("j_hispan"))


def _jobs_linked(t):
    levels = [(lvl, lvl, f"j_{lvl}") for lvl in _LEVELS]
    traits = [("age", "agegrp", "j_age"), ("sex", "p_sex", "j_sex"), ("race", "p_race", "j_race"), ("hispan", "p_hispan", "j_hispan")]
    guesses = [(f"earnings {i}", f"earn_{i}", "j_earn") for i in (1, 2, 3)]
    jobs = cut(_jobs(t), "jobs")
    return jobs, links.jobs_to_persons(Side(_workers(t), "precid"), Side(jobs, "jobid"), levels, traits, guesses, 133)


@query("pl_16", f"WITH {_JOB_SQL}, {_JOB_CTES}, every AS MATERIALIZED ({_JOB_PAIRS}) SELECT precid, jobid, match_round FROM every")
def pl_16(t):
    return _jobs_linked(t)[1].pairs


_OUTSIDE_SQL = """SELECT jobid, j_block, j_block || 'PJ' || lpad(c::VARCHAR, length((max(c) OVER ())::VARCHAR)::INT, '0') AS precid FROM
  (SELECT jobid, j_block, row_number() OVER (PARTITION BY j_block ORDER BY md5(jobid), jobid) AS c FROM {left})"""


@query("pl_16_outside", f"WITH {_JOB_SQL}, {_JOB_CTES}, o AS ({_OUTSIDE_SQL.format(left=f's{len(_JOB_ROUNDS)}')}) SELECT jobid, precid FROM o")
def pl_16_outside(t):
    """Jobs that found no person are held from outside the area."""
    return links.outside_workers(cut(_jobs_linked(t)[1].secondary_left.select("jobid", "j_block"), "outside"), "j_block", "jobid").select("jobid", "precid")


_EST_JOBS_SQL = f"""{_JOB_SQL}, jj AS MATERIALIZED (SELECT jobid, j_block, j_tract, j_age AS industry FROM jb),
es AS (SELECT p_partkey AS estab, p_size % 5 + 1 AS size, p_partkey % 25 AS e_block, (p_partkey % 3 + 1) AS e_industry FROM part), ee AS (SELECT *, unnest(range(1, size::BIGINT + 1)) AS c FROM es),
ej AS MATERIALIZED (SELECT 'J' || estab || 'c' || c AS jestabid, size, e_block, n_regionkey AS e_tract, e_industry FROM ee JOIN nation ON e_block = n_nationkey)"""
_EST_CTES, _EST_PAIRS = cascade_sql("jj", "jobid", "ej", "jestabid", [(["j_block", "industry"], ["e_block", "e_industry"]), (["j_tract", "industry"], ["e_tract", "e_industry"])], 133, s_sort="size")


def _establishments_linked(t, rows=None):
    """``rows`` are the jobs where they are stored already."""
    jobs = (cut(_jobs(t).select("jobid", "j_block", "j_tract", "j_age"), "jobs") if rows is None else rows).select("jobid", "j_block", "j_tract", F.col("j_age").alias("industry"))
    estab = t.part.select(F.col("p_partkey").alias("estab"), (F.col("p_size") % 5 + 1).alias("size"), (F.col("p_partkey") % 25).alias("e_block"), (F.col("p_partkey") % 3 + 1).alias("e_industry"))
    opened = expand_rows(estab, "size", "c", keep_count=True).withColumn("jestabid", F.concat(F.lit("J"), F.col("estab").cast("string"), F.lit("c"), F.col("c").cast("string")))
    opened = cut(opened.join(t.nation, F.col("e_block") == F.col("n_nationkey")).select("jestabid", "estab", "size", "e_block", F.col("n_regionkey").alias("e_tract"), "e_industry"), "places")
    levels = [("block", "j_block", "e_block"), ("tract", "j_tract", "e_tract")]
    return opened, links.jobs_to_establishments(Side(jobs, "jobid"), Side(opened.drop("estab"), "jestabid", [("size", True)]), levels, ("industry", "industry", "e_industry"), 133)


@query("pl_17", f"WITH {_EST_JOBS_SQL}, {_EST_CTES} {_EST_PAIRS}")
def pl_17(t):
    return _establishments_linked(t)[1].pairs


_J_CTES, _J_PAIRS = cascade_sql("pe", "precid", "jb", "jobid", _JOB_ROUNDS, 133, prefix="j")
_E_CTES, _E_PAIRS = cascade_sql("jj", "jobid", "ej", "jestabid", [(["j_block", "industry"], ["e_block", "e_industry"]), (["j_tract", "industry"], ["e_tract", "e_industry"])], 133, s_sort="size", prefix="e")
_U_CTES, _U_PAIRS = cascade_sql("pu", "precid", "su", "srecid", _PUPIL_ROUNDS, 133, prefix="u")


@query("pl_18", f"""WITH {_EST_JOBS_SQL}, {_PUPILS_SQL}, {_J_CTES}, {_E_CTES}, {_U_CTES}, jp AS MATERIALIZED ({_J_PAIRS}), ep AS MATERIALIZED ({_E_PAIRS}), up AS MATERIALIZED ({_U_PAIRS}),
op AS ({_OUTSIDE_SQL.format(left=f'js{len(_JOB_ROUNDS)}')}),
aj AS (SELECT precid::VARCHAR AS precid, jobid, NULL AS j_block FROM jp UNION ALL SELECT precid, jobid, j_block FROM op),
ho AS (SELECT o_orderkey::VARCHAR AS precid, block, {spot_sql('o_orderkey', 71)} + 1 AS hx, {spot_sql('o_orderkey', 89)} + 1 AS hy FROM orders JOIN units ON o_custkey = c_custkey),
sc AS (SELECT precid::VARCHAR AS precid, school, {spot_sql('school', 31)} + 1 AS sx, {spot_sql('school', 43)} + 1 AS sy FROM up JOIN su USING (srecid)),
wk AS (SELECT precid, aj.jobid, j_block, estab, {spot_sql('estab', 13)} + 1 AS wx, {spot_sql('estab', 29)} + 1 AS wy FROM aj LEFT JOIN ep USING (jobid) LEFT JOIN (SELECT 'J' || estab || 'c' || c AS jestabid, estab FROM ee) x USING (jestabid))
SELECT coalesce(ho.precid, wk.precid) AS precid, coalesce(block, j_block)::INT AS block, school, jobid, estab, 'LINESTRING ( ' || hx || ' ' || hy || ', ' || sx || ' ' || sy || ')' AS home_school_line, 'LINESTRING ( ' || hx || ' ' || hy || ', ' || wx || ' ' || wy || ')' AS home_work_line
FROM ho LEFT JOIN sc ON ho.precid = sc.precid FULL JOIN wk ON ho.precid = wk.precid""")
def pl_18(t):
    stored, worked = _jobs_linked(t)
    places, hired = _establishments_linked(t, stored)
    students, learned = _students_linked(t)
    persons = t.orders.join(units(t), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("precid"), "block", (spot(F.col("o_orderkey"), 71) + 1).alias("hx"), (spot(F.col("o_orderkey"), 89) + 1).alias("hy"))
    school = learned.pairs.join(students.select("srecid", "school"), "srecid").select(F.col("precid").cast("string").alias("precid"), "school", (spot(F.col("school"), 31) + 1).alias("sx"), (spot(F.col("school"), 43) + 1).alias("sy"))
    estab = hired.pairs.join(places.select("jestabid", "estab"), "jestabid").select("jobid", "estab", (spot(F.col("estab"), 13) + 1).alias("wx"), (spot(F.col("estab"), 29) + 1).alias("wy"))
    outside = links.outside_workers(cut(worked.secondary_left.select("jobid", "j_block"), "outside"), "j_block", "jobid")
    jobs = worked.pairs.select(F.col("precid").cast("string").alias("precid"), "jobid", F.lit(None).cast("int").alias("block")).unionByName(
        outside.select("precid", "jobid", F.col("j_block").cast("int").alias("block")))
    return links.person_school_job(persons, school, jobs, estab, "precid", "jobid").select("precid", "block", "school", "jobid", "estab", "home_school_line", "home_work_line")


@query("pl_27", f"""
WITH {UNITS_SQL}, u AS (SELECT c_custkey, tract, c_custkey % 5 AS race, c_custkey % 2 AS his FROM units), {SLOTS_SQL}, j AS (SELECT o_orderkey, n_regionkey AS j_tract, o_orderkey % 6 AS j_race, o_orderkey % 2 AS j_his FROM slots JOIN nation ON block = n_nationkey),
a AS (SELECT *, row_number() OVER (PARTITION BY tract, race, his ORDER BY md5(concat_ws('|', c_custkey, 9)), c_custkey) AS rk FROM u), b AS (SELECT *, row_number() OVER (PARTITION BY j_tract, j_race, j_his ORDER BY md5(concat_ws('|', o_orderkey, 9)), o_orderkey) AS rk FROM j)
SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NOT NULL THEN 'job linked' ELSE 'no job' END AS availability FROM a LEFT JOIN b ON tract = j_tract AND race = j_race AND his = j_his AND a.rk = b.rk""")
def pl_27(t):
    homes = units(t).select("c_custkey", "tract", (F.col("c_custkey") % 5).alias("race"), (F.col("c_custkey") % 2).alias("his"))
    jobs = slots(t).join(t.nation, F.col("block") == F.col("n_nationkey")).select(
        "o_orderkey", F.col("n_regionkey").alias("j_tract"), (F.col("o_orderkey") % 6).alias("j_race"), (F.col("o_orderkey") % 2).alias("j_his"))
    merged = random_merge(Side(homes, "c_custkey"), Side(jobs, "o_orderkey"), Round("tract", [("tract", "tract", "j_tract"), ("race", "race", "j_race"), ("his", "his", "j_his")]), 9)
    return merged.filter("c_custkey IS NOT NULL").select("c_custkey", "o_orderkey", F.when(F.col("o_orderkey").isNotNull(), "job linked").otherwise("no job").alias("availability"))


@query("pl_28", f"""WITH {CUST_SQL}, {SUPP_SQL}, near AS (SELECT c_custkey, s_suppkey, {DIST} AS distance FROM a JOIN b ON {DIST} <= 2 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {DIST}, s_suppkey) = 1),
k AS (SELECT s_suppkey, c_custkey, distance FROM near QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, c_custkey) = 1)
SELECT s_name, c_name, distance FROM k JOIN supplier USING (s_suppkey) JOIN customer USING (c_custkey)""")
def pl_28(t):
    linked = links.link_nearest(customer_points(t).drop("cat"), "c_custkey", supplier_points(t).drop("cat"), "s_suppkey", cutoff=2.0)
    return linked.join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey").join(t.customer.select("c_custkey", "c_name"), "c_custkey").select("s_name", "c_name", "distance")


@query("pl_29", """
WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS fte, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 30) AS p410, count(*) AS hrt FROM lineitem GROUP BY 1)
SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 4000 THEN fte END, CASE WHEN s_acctbal > 0 THEN p410 END, hrt) AS numstaff, coalesce(hrt, 0) AS students FROM s RIGHT JOIN supplier ON l_suppkey = s_suppkey""")
def pl_29(t):
    n = lambda c: F.count(F.when(c, 1))
    counts = t.lineitem.groupBy("l_suppkey").agg(
        n(F.col("l_returnflag") == "A").alias("fte"), n((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 30)).alias("p410"), F.count(F.lit(1)).alias("hrt"))
    joined = counts.join(t.supplier.select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"), "right")
    staff = F.coalesce(F.when(F.col("s_acctbal") > 4000, F.col("fte")), F.when(F.col("s_acctbal") > 0, F.col("p410")), F.col("hrt"))
    return joined.select("s_suppkey", staff.alias("numstaff"), F.coalesce("hrt", F.lit(0)).alias("students"))


@query("pl_31", f"""
WITH {UNITS_SQL}, {SLOTS_SQL}, sd AS (SELECT unnest([1, 2, 3]) AS seed), a AS (SELECT c_custkey, block, c_acctbal, seed, row_number() OVER (PARTITION BY seed, block ORDER BY md5(concat_ws('|', c_custkey, seed)), c_custkey) AS rk FROM units, sd),
b AS (SELECT o_orderkey, s.block AS s_block, o_orderstatus, seed AS s_seed, row_number() OVER (PARTITION BY seed, s.block ORDER BY md5(concat_ws('|', o_orderkey, seed)), o_orderkey) AS rk FROM slots s, sd),
m AS (SELECT seed, o_orderstatus, CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END AS poor FROM a JOIN b ON seed = s_seed AND block = s_block AND a.rk = b.rk), d AS (SELECT seed, o_orderstatus, avg(poor) AS share FROM m GROUP BY 1, 2)
SELECT o_orderstatus, round(avg(share), 9) AS mean_share, round(min(share), 9) AS min_share, round(max(share), 9) AS max_share FROM d GROUP BY 1""")
def pl_31(t):
    people = units(t).select("c_custkey", "block", "c_acctbal")
    points = slots(t).select("o_orderkey", F.col("block").alias("s_block"), "o_orderstatus")
    merged = ensemble.merge_ensemble(people, "c_custkey", points, "o_orderkey", [("block", "block", "s_block")], 1, 3)
    share = F.avg(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0))
    stats = ensemble.ensemble_statistics(merged, "o_orderstatus", "seed", share)
    return stats.select("o_orderstatus", *[F.round(c, 9).alias(c) for c in ("mean_share", "min_share", "max_share")])
