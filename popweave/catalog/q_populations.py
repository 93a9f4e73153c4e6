"""Inventories of units and persons, buildings and allocation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.catalog.q_merges import graft_base
from popweave.catalog.q_tables import WIDE_SQL, wide_counts
from popweave.catalog.registry import query
from popweave.catalog.standins import LINES_SQL, band_sql, cascade_sql, lines, money, spot, spot_sql, u_sql
from popweave.functions import bands
from popweave.functions.seeded import random_int
from popweave.operators import profile, recode
from popweave.operators.graft import Margin, graft
from popweave.operators.random_merge import Round, Side, merge_cascade
from popweave.plans import inventory, places
from popweave.session import constant_table, cut

CATALOGUE = [("003", 1, 1), ("004", 1, 2), ("005", 2, 1), ("006", 2, 2)]


@query("pl_01", f"""WITH {WIDE_SQL}, c AS (SELECT * FROM (VALUES ('003', 1, 1), ('004', 1, 2), ('005', 2, 1), ('006', 2, 2)) v(code, ownershp, numprec))
SELECT block, ownershp, numprec, n FROM long JOIN c USING (code)""")
def pl_01(t):
    catalogue = constant_table(t.spark, ["code", "ownershp", "numprec"], CATALOGUE)
    return inventory.characteristic_rows(wide_counts(t), ["block"], "H016", catalogue, "n").select("block", "ownershp", "numprec", "n")


@query("pl_02", f"""WITH {WIDE_SQL}, c AS (SELECT * FROM (VALUES ('003', 1, 1), ('004', 1, 2), ('005', 2, 1), ('006', 2, 2)) v(code, ownershp, numprec)),
g AS (SELECT block, ownershp, numprec, NULL::INT AS vacancy, n FROM long JOIN c USING (code) UNION ALL SELECT s_suppkey, NULL, NULL, s_nationkey % 7 + 1, s_nationkey + 1 FROM supplier),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY block ORDER BY numprec NULLS FIRST, ownershp NULLS FIRST, vacancy NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
o AS (SELECT block, ownershp, numprec, vacancy, (before + unnest(range(1, n::BIGINT + 1)))::BIGINT AS counter FROM p)
SELECT block, ownershp, numprec, vacancy, counter, block || 'H' || lpad(counter::VARCHAR, length((SELECT max(counter) FROM o)::VARCHAR)::INT, '0') AS huid FROM o""")
def pl_02(t):
    catalogue = constant_table(t.spark, ["code", "ownershp", "numprec"], CATALOGUE)
    occupied = inventory.characteristic_rows(wide_counts(t), ["block"], "H016", catalogue, "n").select("block", "numprec", "ownershp", "n")
    vacant = t.supplier.select(F.col("s_suppkey").alias("block"), (F.col("s_nationkey") % 7 + 1).alias("vacancy"), (F.col("s_nationkey") + 1).alias("n"))
    return inventory.base_inventory([occupied, vacant], "block", "n", "H", "huid")


def _households(t):
    """Core counts of households per block with open family and Hispanic traits."""
    base = graft_base(t).join(t.nation, F.col("block") == F.col("n_nationkey"))
    size = F.substring("size", 1, 1).cast("int")
    return base.select("o_orderkey", "block", F.col("n_regionkey").alias("tract"), size.alias("numprec"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("ownershp"),
                       (F.col("race") + 1).cast("int").alias("race"), "truth", (F.col("o_orderkey") % 5 == 0).alias("hisp_truth"))


def _unit_inventory(t):
    rows = cut(_households(t), "households")
    counts = rows.groupBy("block", "tract", "numprec", "ownershp", "race").agg(F.count(F.lit(1)).alias("n"))
    units = inventory.base_inventory([counts], "block", "n", "H", "huid")
    units = units.withColumns({"family": F.when(F.col("numprec") > 1, -999).otherwise(0), "hispan": F.lit(-999), "vacancy": F.lit(None).cast("int"), "gqtype": F.lit(None).cast("int")})
    family = rows.filter("numprec > 1 and truth").groupBy("block", "race").agg(F.count(F.lit(1)).alias("n"))
    hisp = rows.filter("hisp_truth")
    by = lambda *k: hisp.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    units = cut(graft(cut(units, "units"), "huid", "family", [Margin("P18", family, ["block", "race"], "n")]), "units")
    units = graft(units, "huid", "hispan", [Margin("H16", by("block", "ownershp", "numprec"), ["block", "ownershp", "numprec"], "n"),
                                            Margin("H7", by("block", "race"), ["block", "race"], "n"), Margin("H15", by("block", "ownershp"), ["block", "ownershp"], "n")])
    return rows, cut(units, "units")


def _with_income_groups(rows, units):
    group = (F.col("o_orderkey") % 16 + 1).cast("int")
    households = rows.select(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("tid"), F.col("tract").alias("t_tract"), F.col("race").alias("t_race"),
                             F.when(F.col("hisp_truth"), 1).otherwise(0).alias("t_hispan"), group.alias("incomegroup"))
    families = rows.filter("truth").select(F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("fid"), F.col("tract").alias("f_tract"), F.col("race").alias("f_race"),
                                           F.when(F.col("hisp_truth"), 1).otherwise(0).alias("f_hispan"), group.alias("f_group"))
    tract = ("tract", "t_tract", "f_tract")
    rounds = [Round("all", [tract, ("g", "incomegroup", "f_group"), ("r", "t_race", "f_race"), ("h", "t_hispan", "f_hispan")]),
              Round("no income", [tract, ("r", "t_race", "f_race"), ("h", "t_hispan", "f_hispan")]), Round("race", [tract, ("r", "t_race", "f_race")]), Round("tract", [tract])]
    fam = merge_cascade(Side(households, "tid"), Side(families, "fid"), rounds, 2564, stop_early=True)
    income = households.join(fam.pairs.select("tid", F.lit(1).alias("t_family")), "tid", "left").fillna(0, ["t_family"])
    level = ("tract", "tract", "t_tract")
    who = ("who", inventory.by_ethnicity("hispan", "race"), inventory.by_ethnicity("t_hispan", "t_race"))
    county = ("county", "1", "1")
    rounds = inventory.trait_rounds([level, county], [("family", [who, ("f", "family", "t_family")]), ("no family", [who]), ("race", [("r", "race", "t_race")]), ("none", [])])
    slim = units.select("huid", "tract", "hispan", "race", "family")
    linked = merge_cascade(Side(slim, "huid"), Side(income, "tid"), rounds, 2564, reuse="cycles")
    return inventory.take_trait(units, "huid", linked, income, "tid", ["incomegroup"])


@query("pl_04")
def pl_04(t):
    rows, units = _unit_inventory(t)
    done = inventory.polish_units(_with_income_groups(rows, units), "huid", 2564)
    return recode.drop_matching(done, suffixes=["_flag", "_round"])


def _person_inventory(t):
    homes = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = cut(t.lineitem.join(homes, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("c_nationkey").alias("block"), F.col("n_regionkey").alias("tract"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("sex"), (F.col("l_partkey") % 23 + 1).cast("int").alias("agegroupP12"),
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("race"), (F.col("l_discount") > 0.08).alias("hisp_truth"), (F.col("l_partkey") % 101).cast("int").alias("age_truth")), "persons")
    counts = rows.groupBy("block", "tract", "sex", "agegroupP12", "race").agg(F.count(F.lit(1)).alias("n"))
    persons = inventory.base_inventory([counts], "block", "n", "P", "precid").withColumn("hispan", F.lit(-999))
    hisp = rows.filter("hisp_truth")
    margins = [Margin("P12", hisp.groupBy("block", "sex", "agegroupP12").agg(F.count(F.lit(1)).alias("n")), ["block", "sex", "agegroupP12"], "n"),
               Margin("P5", hisp.groupBy("block", "race").agg(F.count(F.lit(1)).alias("n")), ["block", "race"], "n")]
    return rows, cut(graft(cut(persons, "persons"), "precid", "hispan", margins), "persons")


def _with_ages(rows, persons):
    """Single-year ages from the coarser area's table, inside sex and age band."""
    counts = rows.groupBy("tract", F.col("sex").alias("a_sex"), F.col("age_truth").alias("randage")).agg(F.count(F.lit(1)).alias("n"))
    single = inventory.base_inventory([counts], "tract", "n", "A", "aid").select(
        "aid", F.col("tract").alias("a_tract"), "a_sex", "randage", bands.band(F.col("randage"), bands.AGE_P12).alias("a_band"))
    single = cut(single, "ages")
    slim = persons.select("precid", "tract", "sex", "agegroupP12")
    rounds = [Round("band", [("tract", "tract", "a_tract"), ("sex", "sex", "a_sex"), ("band", "agegroupP12", "a_band")])]
    linked = merge_cascade(Side(slim, "precid"), Side(single, "aid"), rounds, 1000)
    aged = inventory.take_trait(persons, "precid", linked, single, "aid", ["randage"])
    low, high = bands.band_low(F.col("agegroupP12"), bands.AGE_P12), bands.band_high(F.col("agegroupP12"), bands.AGE_P12)
    return aged.withColumn("randage", F.coalesce(F.col("randage").cast("long"), random_int(low, high, "precid", 1000)))


@query("pl_05")
def pl_05(t):
    rows, persons = _person_inventory(t)
    return recode.drop_matching(_with_ages(rows, persons), suffixes=["_flag", "_round"])


@query("pl_06")
def pl_06(t):
    """Areas are a column of one job: the inventory with the output structure."""
    rows, units = _unit_inventory(t)
    C = recode.OutColumn
    spec = [C("huid", "string"), C("blockid", "string", "block", 15), C("tractid", "string", "tract", 11), C("area", "string", "cast(tract as string)"),
            C("numprec", "int"), C("ownershp", "int"), C("race", "int"), C("hispan", "int"), C("family", "int"), C("vacancy", "int"), C("gqtype", "int")]
    return recode.conform(units, spec)


# Buildings: parts on 25 blocks; expected units: customers on nations.
_EST_SQL = """b0 AS (SELECT p_partkey, p_partkey % 29 AS block, p_size * 10.0::DOUBLE AS area, CASE WHEN p_type = 'ECONOMY' THEN 2 WHEN p_size > 20 THEN 1 ELSE 0 END AS first FROM part),
ex AS (SELECT c_nationkey::BIGINT + 1 AS block, count(*) AS expected FROM customer GROUP BY 1),
r1 AS (SELECT b0.*, coalesce(expected, 0) AS expected, CASE WHEN coalesce(expected, 0) = 0 THEN 0 ELSE first END AS ap1 FROM b0 LEFT JOIN ex ON b0.block = ex.block),
b1 AS (SELECT block, CASE WHEN e = 0 THEN 1 WHEN e = s THEN 2 WHEN e < s THEN 3 WHEN s = 0 THEN 5 ELSE 4 END AS error1, e - s AS gap FROM (SELECT block, max(expected) AS e, sum(ap1) AS s FROM r1 GROUP BY 1)),
r2 AS (SELECT r1.* EXCLUDE (ap1), error1, gap, CASE WHEN error1 = 5 THEN 1 ELSE ap1 END AS ap1 FROM r1 JOIN b1 ON r1.block = b1.block),
r2a AS (SELECT *, CASE WHEN ap1 = 1 THEN area::BIGINT ELSE 0 END AS ra FROM r2), r2b AS (SELECT *, sum(ra) OVER (PARTITION BY block) AS rs FROM r2a),
r2c AS (SELECT *, CASE WHEN error1 IN (2, 3, 9) THEN ap1 WHEN error1 = 1 THEN 0 WHEN rs = 0 THEN NULL ELSE round_even(ra / rs::DOUBLE * gap, 0)::BIGINT + ap1 END AS ap2 FROM r2b),
b2 AS (SELECT block, CASE WHEN e = 0 THEN 1 WHEN e = s THEN 2 WHEN e < s THEN 3 WHEN s = 0 THEN 5 ELSE 4 END AS error2 FROM (SELECT block, max(expected) AS e, coalesce(sum(ap2), 0) AS s FROM r2c GROUP BY 1)),
est AS (SELECT p_partkey, r2c.block, expected, error1, error2, (CASE WHEN error2 = 4 AND ap2 >= 1 THEN ap2 + 1 WHEN error2 = 5 AND ap2 IS NULL THEN 1 ELSE ap2 END)::BIGINT AS huestimate FROM r2c JOIN b2 ON r2c.block = b2.block)"""


def _estimates(t):
    first = F.when(F.col("p_type") == "ECONOMY", 2).when(F.col("p_size") > 20, 1).otherwise(0)
    buildings = t.part.select("p_partkey", (F.col("p_partkey") % 29).alias("block"), (F.col("p_size") * 10.0).alias("area"), first.alias("first"))
    expected = t.customer.groupBy((F.col("c_nationkey").cast("bigint") + 1).alias("block")).agg(F.count(F.lit(1)).alias("expected"))
    return places.estimate_units(cut(buildings), cut(expected), "block", "area", "first")


@query("pl_07", f"WITH {_EST_SQL} SELECT p_partkey, block, expected, error1, error2, huestimate FROM est")
def pl_07(t):
    return _estimates(t).select("p_partkey", "block", "expected", "error1", "error2", "huestimate")


@query("pl_07_fit", f"WITH {_EST_SQL} SELECT round(corr(e, h), 9) AS r, count(*) AS blocks FROM (SELECT block, max(expected) AS e, sum(huestimate) AS h FROM est GROUP BY 1)")
def pl_07_fit(t):
    return places.estimate_fit(_estimates(t), "block").withColumn("r", F.round("r", 9))


_ADDR_SQL = f"""{_EST_SQL}, sl AS (SELECT p_partkey, block, huestimate, unnest(range(1, greatest(coalesce(huestimate, 1), 1) + 1)) AS i FROM est),
sr AS (SELECT *, p_partkey || '|' || i AS slot, row_number() OVER (PARTITION BY block ORDER BY md5(p_partkey || '|' || i), p_partkey || '|' || i) AS rk FROM sl),
cs AS (SELECT block, expected, unnest(range(1, expected + 1)) AS i FROM ex), cr AS (SELECT *, block || '|' || i AS cslot, row_number() OVER (PARTITION BY block ORDER BY md5(block || '|' || i), block || '|' || i) AS rk FROM cs),
pa AS (SELECT p_partkey, coalesce(sr.block, cr.block) AS block, huestimate, cr.expected, coalesce(slot, '') || '|' || coalesce(cslot, '') AS pk FROM sr FULL JOIN cr ON sr.block = cr.block AND sr.rk = cr.rk),
st AS (SELECT *, CASE WHEN p_partkey IS NULL THEN 'C' || lpad(block::VARCHAR, 36, '0') ELSE 'ST' || lpad(p_partkey::VARCHAR, 36, '0') END AS strctid FROM pa),
ad AS (SELECT *, row_number() OVER (PARTITION BY strctid ORDER BY md5(pk), pk) - 1 AS apcounter, CASE WHEN p_partkey IS NULL THEN 2 WHEN expected IS NULL THEN 1 ELSE 0 END AS flag_ap FROM st)"""


def _addresses(t):
    estimates = cut(_estimates(t).select("p_partkey", "block", "huestimate"), "estimates")
    expected = t.customer.groupBy((F.col("c_nationkey").cast("bigint") + 1).alias("block")).agg(F.count(F.lit(1)).alias("expected"))
    return cut(places.address_points(estimates, expected, "p_partkey", "block", "huestimate", "expected"), "addresses"), estimates


@query("pl_08", f"""WITH {_ADDR_SQL} SELECT strctid || 'AP' || lpad(apcounter::VARCHAR, 6, '0') AS addrptid, p_partkey, block, flag_ap, CASE WHEN apcounter = 0 AND flag_ap <= 1 THEN 1 ELSE 0 END AS bldgobs,
  CASE WHEN p_partkey IS NULL OR huestimate > 0 THEN 1 ELSE 0 END AS residential FROM ad""")
def pl_08(t):
    points, _ = _addresses(t)
    return points.select("addrptid", "p_partkey", "block", "flag_ap", "bldgobs", "residential")


def _allocate(t):
    points, estimates = _addresses(t)
    points = points.select("addrptid", "strctid", "p_partkey", "block", (F.col("apcounter") + 1).alias("place"), F.col("huestimate").alias("units"))
    units = t.customer.select("c_custkey", F.col("c_nationkey").alias("ublock"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 2 + 1).cast("int")).alias("ownershp"))
    allocation = places.allocate_units(Side(units, "c_custkey"), points, "addrptid", "strctid", ("block", F.col("ublock"), F.col("block")),
                                       ("group", F.floor(F.col("ublock") / 5), F.floor(F.col("block") / 5)), "ownershp", 42)
    return units, points, allocation


def _allocation_sql():
    guess = lambda j: (["ublk", "{p}", "ten"], ["blk", "place", f"g{j}"])
    update = """(CASE WHEN r > 2 THEN 2 WHEN r > 1 AND r < 2 THEN 1 WHEN r < 1 THEN -777 ELSE r END)::INT"""
    parts, ctes, held = [], [], "held0"
    people = "people"
    for place in (1, 2, 3):
        rounds = [([k.replace("{p}", str(place)) for k in a], b) for a, b in (guess(1), guess(2), guess(3))]
        text, pairs = cascade_sql(people, "c_custkey", held, "addrptid", rounds, 42, prefix=f"c{place}", first=3 * place - 2)
        parts.append(pairs)
        ctes += [text, f"""done{place} AS ({' UNION ALL '.join(parts)})""",
                 f"""mean{place} AS (SELECT strctid, avg(own) AS m FROM done{place} JOIN ad2 USING (addrptid) JOIN un USING (c_custkey) GROUP BY 1)""",
                 f"""held{place} AS MATERIALIZED (SELECT addrptid, strctid, place, blk, bg, {update} AS g1, g2, g3 FROM (SELECT h.*, CASE WHEN g1 = 1 AND m IS NOT NULL AND m <> g1 THEN m ELSE g1 END AS r FROM c{place}s3 h LEFT JOIN mean{place} USING (strctid)))"""]
        people, held = f"c{place}p3", f"held{place}"
    rounds = [(["ublk", "ten"], ["blk", "g1"]), (["ublk"], ["blk"]), (["ubg", "ten"], ["bg", "g1"]), (["ubg"], ["bg"])]
    text, pairs = cascade_sql(people, "c_custkey", held, "addrptid", rounds, 42, prefix="c4", first=10)
    body = ", ".join([*ctes, text])
    return f"""{_ADDR_SQL}, ad2 AS MATERIALIZED (SELECT strctid || 'AP' || lpad(apcounter::VARCHAR, 6, '0') AS addrptid, strctid, p_partkey, block, apcounter + 1 AS place, huestimate FROM ad),
un AS (SELECT c_custkey, c_nationkey AS ublock, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 2 + 1)::INT END AS own FROM customer), people AS (SELECT c_custkey, coalesce(own, 0) AS ten, ublock AS ublk, ublock // 5 AS ubg FROM un),
held0 AS (SELECT addrptid, strctid, place, block AS blk, block // 5 AS bg, CASE WHEN huestimate IN (1, 2) THEN 1 ELSE -777 END AS g1, CASE WHEN huestimate > 2 THEN 2 ELSE -777 END AS g2, CASE WHEN huestimate > 0 THEN 2 ELSE -777 END AS g3 FROM ad2),
{body}, alloc AS ({' UNION ALL '.join([*parts, pairs])})"""


_ALLOC_SQL = _allocation_sql()


@query("pl_09", f"WITH {_ALLOC_SQL} SELECT * FROM alloc")
def pl_09(t):
    return _allocate(t)[2]


@query("pl_10", f"""WITH {_ALLOC_SQL} SELECT u.c_custkey, u.ublock, u.own AS ownershp, a.addrptid, a.match_round, ad2.strctid, coalesce(ad2.p_partkey::VARCHAR, 'missing building id') AS p_partkey,
  p_type AS archetype, {spot_sql('part.p_partkey', 13)} AS x, {spot_sql('part.p_partkey', 29)} AS y FROM un u LEFT JOIN alloc a ON u.c_custkey = a.c_custkey LEFT JOIN ad2 ON a.addrptid = ad2.addrptid LEFT JOIN part ON ad2.p_partkey = part.p_partkey""")
def pl_10(t):
    units, points, allocation = _allocate(t)
    buildings = t.part.select(F.col("p_partkey"), F.col("p_type").alias("archetype"), spot(F.col("p_partkey"), 13).alias("x"), spot(F.col("p_partkey"), 29).alias("y"))
    return places.link_community(units, "c_custkey", allocation, points, "addrptid", buildings, "p_partkey", ["archetype", "x", "y"])


# Householder ages: units (orders) take an age record (customers) by tenure, race and ethnicity.
_H17_ROUNDS = [(["block", "own", "his", "race"], ["a_block", "a_own", "a_his", "a_race"]), (["block", "his", "race"], ["a_block", "a_his", "a_race"]), (["block", "race"], ["a_block", "a_race"]), (["block"], ["a_block"]),
               (["tract", "own", "his", "race"], ["a_tract", "a_own", "a_his", "a_race"]), (["tract"], ["a_tract"])]
_H17_CTES, _H17_PAIRS = cascade_sql("un", "o_orderkey", "ag", "c_custkey", _H17_ROUNDS, 133)


@query("pl_11", f"""WITH un AS (SELECT o_orderkey, c_nationkey AS block, n_regionkey AS tract, o_orderkey % 2 + 1 AS own, o_orderkey % 3 AS his, o_orderkey % 5 AS race FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ag AS (SELECT c_custkey, c_nationkey AS a_block, n_regionkey AS a_tract, c_custkey % 2 + 1 AS a_own, c_custkey % 3 AS a_his, c_custkey % 6 AS a_race, (15 + c_custkey % 80)::BIGINT AS lo, (15 + c_custkey % 80 + 9)::BIGINT AS hi
  FROM customer JOIN nation ON c_nationkey = n_nationkey), {_H17_CTES}, pairs AS ({_H17_PAIRS}),
r AS (SELECT o_orderkey, match_round, floor(lo + {u_sql('c_custkey', 133)} * (hi - lo))::BIGINT AS age FROM pairs JOIN ag USING (c_custkey))
SELECT u.o_orderkey, match_round, age AS "randageH17", CASE WHEN age IS NULL THEN -999 ELSE {band_sql('age', bands.AGE_H17)} END AS "agegroupH17" FROM un u LEFT JOIN r ON u.o_orderkey = r.o_orderkey""")
def pl_11(t):
    located = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("block"), F.col("n_regionkey").alias("tract"))
    key, o = F.col("c_custkey"), F.col("o_orderkey")
    units = t.orders.join(located, F.col("o_custkey") == key).select("o_orderkey", "block", "tract", (o % 2 + 1).alias("own"), (o % 3).alias("his"), (o % 5).alias("race"))
    low = 15 + key % 80
    ages = located.select("c_custkey", F.col("block").alias("a_block"), F.col("tract").alias("a_tract"), (key % 2 + 1).alias("a_own"), (key % 3).alias("a_his"), (key % 6).alias("a_race"),
                          random_int(low, low + 9, "c_custkey", 133).alias("randageH17"))
    k = {n: (n, n, f"a_{n}") for n in ("block", "tract", "own", "his", "race")}
    all_keys = [k["own"], k["his"], k["race"]]
    rounds = [Round("block all", [k["block"], *all_keys]), Round("block who", [k["block"], k["his"], k["race"]]), Round("block race", [k["block"], k["race"]]), Round("block", [k["block"]]),
              Round("tract all", [k["tract"], *all_keys]), Round("tract", [k["tract"]])]
    linked = merge_cascade(Side(units, "o_orderkey"), Side(ages.drop("randageH17"), "c_custkey"), rounds, 133)
    out = inventory.take_trait(units, "o_orderkey", linked, ages, "c_custkey", ["randageH17"])
    return out.select("o_orderkey", "match_round", "randageH17", F.coalesce(bands.band(F.col("randageH17"), bands.AGE_H17), F.lit(-999)).alias("agegroupH17"))


@query("pl_12", """
WITH u AS (SELECT o_orderkey, c_nationkey AS block, (o_custkey % 8)::BIGINT AS numprec, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS gqtype FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT c_nationkey AS block, count(*) AS persons FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
g AS (SELECT u.block, floor((max(persons) - sum(numprec)) / count(*) FILTER (numprec = 7 AND gqtype = 0)::DOUBLE)::BIGINT AS add FROM u JOIN p ON u.block = p.block GROUP BY 1 HAVING count(*) FILTER (numprec = 7 AND gqtype = 0) > 0)
SELECT o_orderkey, CASE WHEN numprec = 7 AND gqtype = 0 THEN greatest(7 + coalesce(add, 0), 7) ELSE numprec END AS numprec FROM u LEFT JOIN g ON u.block = g.block""")
def pl_12(t):
    homes = t.customer.select("c_custkey", F.col("c_nationkey").alias("block"))
    orders = t.orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    units = orders.select("o_orderkey", "block", (F.col("o_custkey") % 8).alias("numprec"), F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0).alias("gqtype"))
    persons = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("block").agg(F.count(F.lit(1)).alias("persons"))
    return inventory.adjust_large_units(units, persons, "block").select("o_orderkey", "numprec")


_PLACE_ROUNDS = [(["p_block", *p], ["block", *b]) for p, b in [
    (["p_h17", "p_sex", "p_race", "p_hispan"], ["h17", "sex", "race", "hispan"]), (["p_sex", "p_p43"], ["sex", "age_gq"]), (["p_race", "p_hispan", "p_child"], ["race", "hispan", "child"]),
    (["p_child"], ["child"]), (["p_race", "p_hispan", "p_h17"], ["race", "hispan", "h17"]), (["p_h18", "p_sex", "p_race", "p_hispan"], ["h18", "sex", "race", "hispan"]), ([], [])]]
_PLACE_CTES, _PLACE_PAIRS = cascade_sql("pe", "precid", "sp", "place_id", _PLACE_ROUNDS, 133)


@query("pl_13", f"""WITH o AS MATERIALIZED (SELECT o_orderkey, c_nationkey AS block, (o_custkey % 8)::BIGINT AS numprec, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS gqtype, o_custkey % 4 AS race, o_custkey % 2 AS hispan, o_orderkey % 3 AS s,
  o_orderkey % 2 AS family, o_orderkey % 9 + 1 AS h17, o_orderkey % 3 + 1 AS h18 FROM orders JOIN customer ON o_custkey = c_custkey),
pe0 AS (SELECT line_key AS precid, block AS p_block, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS p_sex, l_suppkey % 4 AS p_race, l_partkey % 2 AS p_hispan, l_partkey % 101 AS age FROM {LINES_SQL} JOIN o ON l_orderkey = o_orderkey),
pe AS MATERIALIZED (SELECT *, {band_sql('age', bands.AGE_H17, '0')} AS p_h17, {band_sql('age', bands.AGE_H18, '0')} AS p_h18, {band_sql('age', bands.AGE_P43, '0')} AS p_p43, CASE WHEN age < 18 THEN 1 ELSE 0 END AS p_child FROM pe0),
pn AS (SELECT p_block AS block, count(*) AS persons FROM pe GROUP BY 1),
g AS (SELECT o.block, floor((max(persons) - sum(numprec)) / count(*) FILTER (numprec = 7 AND gqtype = 0)::DOUBLE)::BIGINT AS add FROM o JOIN pn ON o.block = pn.block GROUP BY 1 HAVING count(*) FILTER (numprec = 7 AND gqtype = 0) > 0),
sz AS (SELECT o.* EXCLUDE (numprec), CASE WHEN numprec = 7 AND gqtype = 0 THEN greatest(7 + coalesce(add, 0), 7) ELSE numprec END AS numprec FROM o LEFT JOIN g ON o.block = g.block),
op AS (SELECT *, unnest(range(1, numprec + 1)) AS pernum FROM sz),
rl AS (SELECT *, CASE WHEN s = 0 THEN -999 ELSE s END AS sx, family = 1 AND gqtype = 0 AND ((s = 0 AND pernum > 2) OR (s <> 0 AND pernum > 1)) AS ch FROM op),
sp AS MATERIALIZED (SELECT o_orderkey || 'P' || pernum AS place_id, block, race, hispan, CASE WHEN ch THEN -999 ELSE sx END AS sex, CASE WHEN ch THEN 1 ELSE -999 END AS child,
  CASE WHEN ch OR (gqtype = 0 AND pernum > 2) THEN -999 ELSE h17 END AS h17, CASE WHEN ch OR (gqtype = 0 AND pernum > 2) THEN -999 ELSE rl.h18 END AS h18, CASE WHEN gqtype > 0 THEN rl.h18 END AS age_gq FROM rl),
{_PLACE_CTES} {_PLACE_PAIRS}""")
def pl_13(t):
    """Order lines as persons, orders as housing units; both sit in the block of their customer."""
    homes = t.customer.select("c_custkey", F.col("c_nationkey").alias("block"))
    orders = cut(t.orders.join(homes, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "block", (F.col("o_custkey") % 8).alias("numprec"), F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0).alias("gqtype"),
        (F.col("o_custkey") % 4).alias("race"), (F.col("o_custkey") % 2).alias("hispan"), (F.col("o_orderkey") % 3).alias("s"), (F.col("o_orderkey") % 2).cast("int").alias("family"),
        (F.col("o_orderkey") % 9 + 1).cast("int").alias("h17"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("h18")), "units")
    persons = lines(t).join(orders.select("o_orderkey", "block"), F.col("l_orderkey") == F.col("o_orderkey"))
    age = (F.col("l_partkey") % 101).cast("int")
    persons = cut(persons.select(
        F.col("line_key").alias("precid"),
        F.col("block").alias("p_block"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("p_sex"), (F.col("l_suppkey") % 4).alias("p_race"), (F.col("l_partkey") % 2).alias("p_hispan"),
        bands.band(age, bands.AGE_H17, 0).alias("p_h17"), bands.band(age, bands.AGE_H18, 0).alias("p_h18"), bands.band(age, bands.AGE_P43, 0).alias("p_p43"),
        F.when(age < 18, 1).otherwise(0).alias("p_child")), "persons")
    sized = inventory.adjust_large_units(orders, persons.groupBy(F.col("p_block").alias("block")).agg(F.count(F.lit(1)).alias("persons")), "block")
    opened = inventory.open_units(cut(sized, "sized"), "numprec", "o_orderkey")
    sex = F.when(F.col("s") == 0, -999).otherwise(F.col("s")).cast("int")
    roles = recode.family_resets(F.col("pernum"), F.col("family"), sex, F.col("gqtype"), F.col("h17"), F.col("h18"))
    spots = opened.withColumns(roles).withColumn("age_gq", F.when(F.col("gqtype") > 0, F.col("h18"))).select(
        "place_id", "block", "sex", "race", "hispan", "child", "agegroupH17", "agegroupH18", "age_gq", "o_orderkey", "pernum")
    keys = {"age9": ("p_h17", "agegroupH17"), "age3": ("p_h18", "agegroupH18"), "age_gq": ("p_p43", "age_gq"), "sex": ("p_sex", "sex"), "race": ("p_race", "race"),
            "hispan": ("p_hispan", "hispan"), "child": ("p_child", "child")}
    linked = inventory.place_persons(Side(persons, "precid"), Side(cut(spots, "places"), "place_id"), ("block", "p_block", "block"), keys, 133)
    return linked.pairs


def _profile_sql(column):
    deciles = ", ".join(f"quantile_cont({column}, {i / 10})::DOUBLE AS p{i}0" for i in range(1, 10))
    names = ["n", "valid", "missing", "min", "max", "mean", "sd", *[f"p{i}0" for i in range(1, 10)]]
    return (f"SELECT variable, name AS statistic, round(value, 4) AS value FROM (UNPIVOT (SELECT '{column}' AS variable, count(*)::DOUBLE AS n, count({column})::DOUBLE AS valid, (count(*) - count({column}))::DOUBLE AS missing, "
            f"min({column})::DOUBLE AS min, max({column})::DOUBLE AS max, avg({column}) AS mean, stddev_samp({column}) AS sd, {deciles} FROM orders) ON {', '.join(names)} INTO NAME name VALUE value)")


_TEXT_SQL = """SELECT variable, name AS statistic, value FROM (UNPIVOT (SELECT 'o_orderpriority' AS variable, count(*)::DOUBLE AS n, count(o_orderpriority)::DOUBLE AS valid, count(DISTINCT o_orderpriority)::DOUBLE AS "distinct",
  min(length(o_orderpriority))::DOUBLE AS min_length, max(length(o_orderpriority))::DOUBLE AS max_length FROM orders) ON n, valid, "distinct", min_length, max_length INTO NAME name VALUE value)"""


# Categories: the summary of a code, and per label (all labels, also without rows) count, share and population.
_CATEGORY_SQL = """SELECT variable, name AS statistic, value FROM (UNPIVOT (SELECT 'quality' AS variable, count(*)::DOUBLE AS n, count(quality)::DOUBLE AS valid, (count(*) - count(quality))::DOUBLE AS missing,
  min(quality)::DOUBLE AS min, max(quality)::DOUBLE AS max FROM documents LEFT JOIN labels USING (doc_id)) ON n, valid, missing, min, max INTO NAME name VALUE value)
UNION ALL SELECT 'o_orderstatus', name || ' ' || code, round(value, 4) FROM (UNPIVOT (
  SELECT coalesce(code, o_orderstatus) AS code, coalesce(n, 0)::DOUBLE AS n, round_even(coalesce(n, 0) / (SELECT count(*) FROM orders)::DOUBLE * 100, 6) AS percent, coalesce(w, 0)::DOUBLE AS population
  FROM (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS w FROM orders GROUP BY 1) FULL JOIN (SELECT unnest(['F', 'O', 'X']) AS code) ON code = o_orderstatus) ON n, percent, population INTO NAME name VALUE value)"""


def _category_rows(t):
    summary = profile.category_summary(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality")
    names = [c for c in summary.columns if c != "variable"]
    first = summary.select("variable", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["variable"], names, "statistic", "value")
    labels = constant_table(t.spark, ["code", "label"], [(c, f"status {c}") for c in ("F", "O", "X")])
    table = profile.category_table(t.orders.select("o_orderstatus", money("o_totalprice").alias("w")), "o_orderstatus", labels, "code", "w")
    kinds = {"n": "n", "percent": "percent", "weighted": "population"}
    wide = table.select("code", *[F.col(c).cast("double").alias(k) for c, k in kinds.items()])
    second = wide.unpivot(["code"], list(kinds.values()), "name", "value")
    return first.unionByName(second.select(F.lit("o_orderstatus").alias("variable"), F.concat_ws(" ", "name", "code").alias("statistic"), "value"))


@query("pl_30", f"{_profile_sql('o_totalprice')} UNION ALL {_profile_sql('o_custkey')} UNION ALL {_TEXT_SQL} UNION ALL {_CATEGORY_SQL}")
def pl_30(t):
    """Profile of a table: one row per column (numeric, text or categorical) and statistic."""
    parts = []
    for column in ("o_totalprice", "o_custkey"):
        wide = profile.numeric_profile(t.orders.select(column), column)
        names = [c for c in wide.columns if c != "variable"]
        parts.append(wide.select("variable", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["variable"], names, "statistic", "value"))
    text = profile.text_profile(t.orders.select("o_orderpriority"), "o_orderpriority")
    names = [c for c in text.columns if c != "variable"]
    parts.append(text.select("variable", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["variable"], names, "statistic", "value"))
    parts.append(_category_rows(t))
    return reduce(DataFrame.unionByName, parts).withColumn("value", F.round("value", 4))
