"""Seeded random merges and the graft."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query
from popweave.catalog.standins import LINES_SQL, SLOTS_SQL, UNITS_SQL, cascade_sql, lines, slots, units
from popweave.operators import reshape, tabulate
from popweave.operators.graft import Margin, graft
from popweave.operators.random_merge import Round, Side, match_flag, merge_cascade, random_merge
from popweave.operators.ranks import random_rank, synthetic_key
from popweave.session import cut

KEY = "block"
SEED = 42


def primary(t):
    return units(t).select("c_custkey", "block", "tract", "c_mktsegment", (F.col("c_custkey") % 5).alias("cls"))


def secondary(t):
    rows = slots(t).join(t.nation, F.col("block") == F.col("n_nationkey"))
    return rows.select("o_orderkey", F.col("block").alias("s_block"), F.col("n_regionkey").alias("s_tract"),
                       (F.col("o_orderkey") % 7).alias("s_cls"), "o_orderstatus")


_P = f"{UNITS_SQL}, prim AS (SELECT c_custkey, block, tract, c_mktsegment, c_custkey % 5 AS cls FROM units)"
_S = f"{SLOTS_SQL}, secd AS (SELECT o_orderkey, block AS s_block, n_regionkey AS s_tract, o_orderkey % 7 AS s_cls, o_orderstatus FROM slots JOIN nation ON block = n_nationkey)"

BLOCK = ("block", "block", "s_block")
TRACT = ("tract", "tract", "s_tract")
CLS = ("cls", "cls", "s_cls")


@query("jn_07", f"""
WITH {_P}, {_S}, a AS (SELECT *, row_number() OVER (PARTITION BY block, cls ORDER BY md5(concat_ws('|', c_custkey, {SEED})), c_custkey) AS rk FROM prim),
b AS (SELECT *, row_number() OVER (PARTITION BY s_block, s_cls ORDER BY o_orderstatus, md5(concat_ws('|', o_orderkey, {SEED})), o_orderkey) AS rk FROM secd)
SELECT c_custkey, o_orderkey, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN o_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS merge_state
FROM a FULL JOIN b ON block = s_block AND cls = s_cls AND a.rk = b.rk""")
def jn_07(t):
    merged = random_merge(Side(primary(t), "c_custkey"), Side(secondary(t), "o_orderkey", [("o_orderstatus", True)]),
                          Round("one", [BLOCK, CLS]), SEED)
    return merged.select("c_custkey", "o_orderkey", "merge_state")


# Orders look for customers here: ten rows compete for one, so every level has
# work and rows are left over.
_ROUNDS = [(["s_block", "s_cls"], ["block", "cls"]), (["s_block"], ["block"]), (["s_tract", "s_cls"], ["tract", "cls"]), (["s_tract"], ["tract"])]
_CTES, _PAIRS = cascade_sql("secd", "o_orderkey", "prim", "c_custkey", _ROUNDS, SEED)
TO_BLOCK, TO_TRACT, TO_CLS = ("block", "s_block", "block"), ("tract", "s_tract", "tract"), ("cls", "s_cls", "cls")


def _seekers(t):
    return Side(secondary(t), "o_orderkey"), Side(primary(t), "c_custkey")


@query("jn_08", f"WITH {_P}, {_S}, {_CTES} {_PAIRS}")
def jn_08(t):
    rounds = [Round("block cls", [TO_BLOCK, TO_CLS]), Round("block", [TO_BLOCK]), Round("tract cls", [TO_TRACT, TO_CLS]), Round("tract", [TO_TRACT])]
    return merge_cascade(*_seekers(t), rounds, SEED).pairs


_CTES2, _PAIRS2 = cascade_sql("secd", "o_orderkey", "prim", "c_custkey", [(["s_block"], ["block"])], SEED)


@query("jn_08_modulo", f"""WITH {_P}, {_S}, {_CTES2},
l AS (SELECT o_orderkey, s_block, row_number() OVER (PARTITION BY s_block ORDER BY md5(concat_ws('|', o_orderkey, {SEED + 2})), o_orderkey) AS rk FROM p1),
r AS (SELECT c_custkey, block, row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws('|', c_custkey, {SEED + 2})), c_custkey) AS rk, count(*) OVER (PARTITION BY block) AS n FROM prim)
{_PAIRS2} UNION ALL SELECT o_orderkey, c_custkey, 2 FROM l JOIN r ON s_block = block AND (l.rk - 1) % n + 1 = r.rk""")
def jn_08_modulo(t):
    return merge_cascade(*_seekers(t), [Round("block", [TO_BLOCK])], SEED, reuse="modulo").pairs


def _wrap_sql(left: str, p_key: str, s_key: str, number: int) -> str:
    return f"""SELECT o_orderkey, c_custkey, {number} AS match_round FROM
  (SELECT o_orderkey, {p_key}, row_number() OVER (PARTITION BY {p_key} ORDER BY md5(concat_ws('|', o_orderkey, {SEED + number})), o_orderkey) AS rk FROM {left}) l
  JOIN (SELECT c_custkey, {s_key}, row_number() OVER (PARTITION BY {s_key} ORDER BY md5(concat_ws('|', c_custkey, {SEED + number})), c_custkey) AS rk,
               count(*) OVER (PARTITION BY {s_key}) AS n FROM prim) r ON {p_key} = {s_key} AND (l.rk - 1) % n + 1 = r.rk"""


_CTES3, _PAIRS3 = cascade_sql("secd", "o_orderkey", "prim", "c_custkey", [(["s_block"], ["block"]), (["s_tract"], ["tract"])], SEED)


@query("jn_08_cycles", f"""WITH {_P}, {_S}, {_CTES3}, w3 AS MATERIALIZED ({_wrap_sql("p2", "s_block", "block", 3)}),
p3 AS MATERIALIZED (SELECT * FROM p2 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM w3)), w4 AS ({_wrap_sql("p3", "s_tract", "tract", 4)})
{_PAIRS3} UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4""")
def jn_08_cycles(t):
    return merge_cascade(*_seekers(t), [Round("block", [TO_BLOCK], "block"), Round("tract", [TO_TRACT], "tract")], SEED, reuse="cycles").pairs


_FLAG_CTE, _FLAG_PAIRS = cascade_sql("prim2", "c_custkey", "secd", "o_orderkey", [(["block", "req"], ["s_block", "s_cls"])], SEED)


@query("prj_30", f"""
WITH {_P}, {_S}, prim2 AS (SELECT *, CASE WHEN cls <> 4 THEN cls END AS req, c_mktsegment = 'BUILDING' AS preset FROM prim), {_FLAG_CTE}
SELECT p.c_custkey, CASE WHEN preset THEN -777.0 WHEN req IS NULL THEN -888.0 WHEN o_orderstatus <> 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS match_flag
FROM prim2 p LEFT JOIN m1 ON p.c_custkey = m1.c_custkey LEFT JOIN secd s ON m1.o_orderkey = s.o_orderkey""")
def prj_30(t):
    p = primary(t).withColumn("req", F.when(F.col("cls") != 4, F.col("cls")))
    merged = random_merge(Side(p, "c_custkey"), Side(secondary(t), "o_orderkey"),
                          Round("one", [BLOCK, ("req", F.col("req"), F.col("s_cls"))]), SEED + 1)
    has_p, has_s = F.col("c_custkey").isNotNull(), F.col("o_orderkey").isNotNull()
    flag = match_flag(F.col("o_orderstatus"), "F", has_p, has_s, F.col("req").isNotNull(), F.col("c_mktsegment") == "BUILDING", 1)
    return merged.filter(has_p).select("c_custkey", flag.alias("match_flag"))


# --- graft -------------------------------------------------------------------

_GRAFT_BASE = """base AS (SELECT o_orderkey, c_nationkey AS block, o_orderpriority AS size, o_custkey % 4 AS race, o_totalprice > 150000 + (o_custkey % 4) * 60000 AS truth,
  CASE WHEN o_orderstatus = 'P' THEN -999 WHEN o_orderkey % 10 = 0 THEN 1 WHEN o_orderkey % 10 = 1 THEN 0 ELSE -999 END AS fam, o_orderstatus = 'P' AS na FROM orders JOIN customer ON o_custkey = c_custkey)"""


def graft_base(t):
    o = F.col("o_orderkey")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    race = F.col("o_custkey") % 4
    return rows.select("o_orderkey", F.col("c_nationkey").alias("block"), F.col("o_orderpriority").alias("size"), race.alias("race"),
                       (F.col("o_totalprice") > 150000 + race * 60000).alias("truth"),
                       F.when(F.col("o_orderstatus") == "P", -999).when(o % 10 == 0, 1).when(o % 10 == 1, 0).otherwise(-999).alias("family"),
                       (F.col("o_orderstatus") == "P").alias("na"))


@query("pl_03", f"""
WITH {_GRAFT_BASE}, t1 AS (SELECT block, size, race, count(*) FILTER (truth AND NOT na) AS n FROM base WHERE size < '4' GROUP BY 1, 2, 3),
t2 AS (SELECT block, race, count(*) FILTER (truth AND NOT na) AS n FROM base GROUP BY 1, 2),
o0 AS (SELECT *, 1.0::DOUBLE AS tp FROM base WHERE fam = -999 AND NOT na),
d0 AS (SELECT o_orderkey, block, size, race, CASE WHEN na THEN NULL ELSE fam END AS value, CASE WHEN na THEN 'not applicable' ELSE 'given' END AS flag FROM base WHERE fam <> -999 OR na),
l1 AS (SELECT block, size, race, sum(n) AS l FROM (SELECT * FROM t1 UNION ALL SELECT block, size, race, -count(*) FROM d0 WHERE value = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
q1 AS (SELECT o.*, coalesce(l, 0) / count(*) OVER (PARTITION BY o.block, o.size, o.race)::DOUBLE AS p FROM o0 o LEFT JOIN l1 ON o.block = l1.block AND o.size = l1.size AND o.race = l1.race),
d1 AS (SELECT o_orderkey, block, size, race, CASE WHEN p = 1 THEN 1 ELSE 0 END AS value, CASE WHEN p = 1 THEN 'certain full' ELSE 'none full' END AS flag FROM q1 WHERE p IN (0, 1)),
o1 AS (SELECT o_orderkey, block, size, race, tp * p AS tp FROM q1 WHERE p NOT IN (0, 1)), e1 AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1),
l2 AS (SELECT block, race, sum(n) AS l FROM (SELECT * FROM t2 UNION ALL SELECT block, race, -count(*) FROM e1 WHERE value = 1 GROUP BY 1, 2) GROUP BY 1, 2),
q2 AS (SELECT o.*, coalesce(l, 0) / count(*) OVER (PARTITION BY o.block, o.race)::DOUBLE AS p FROM o1 o LEFT JOIN l2 ON o.block = l2.block AND o.race = l2.race),
d2 AS (SELECT o_orderkey, block, size, race, CASE WHEN p = 1 THEN 1 ELSE 0 END AS value, CASE WHEN p = 1 THEN 'certain race' ELSE 'none race' END AS flag FROM q2 WHERE p IN (0, 1)),
o2 AS (SELECT o_orderkey, block, size, race, tp * p AS tp FROM q2 WHERE p NOT IN (0, 1)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY block, size, race ORDER BY tp DESC, md5(o_orderkey::VARCHAR), o_orderkey) AS c0, row_number() OVER (PARTITION BY block, race ORDER BY tp DESC, md5(o_orderkey::VARCHAR), o_orderkey) AS c1 FROM o2),
s0 AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2),
r1 AS (SELECT block, size, race, sum(n) AS l FROM (SELECT * FROM t1 UNION ALL SELECT block, size, race, -count(*) FROM s0 WHERE value = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
k1 AS (SELECT c2.*, c0 <= coalesce(l, 0) AS take FROM c2 LEFT JOIN r1 ON c2.block = r1.block AND c2.size = r1.size AND c2.race = r1.race),
s1 AS (SELECT * FROM s0 UNION ALL SELECT o_orderkey, block, size, race, 1, 'counted full' FROM k1 WHERE take),
r2 AS (SELECT block, race, sum(n) AS l FROM (SELECT * FROM t2 UNION ALL SELECT block, race, -count(*) FROM s1 WHERE value = 1 GROUP BY 1, 2) GROUP BY 1, 2),
k2 AS (SELECT k1.o_orderkey, c1 <= coalesce(l, 0) AS take FROM k1 LEFT JOIN r2 ON k1.block = r2.block AND k1.race = r2.race WHERE NOT k1.take)
SELECT o_orderkey, value::INT AS family, flag AS family_flag FROM d0 UNION ALL SELECT o_orderkey, value, flag FROM s1
UNION ALL SELECT o_orderkey, CASE WHEN take THEN 1 ELSE 0 END, CASE WHEN take THEN 'counted race' ELSE 'beyond full' END FROM k2""")
def pl_03(t):
    base = cut(graft_base(t))
    n = F.count(F.when(F.col("truth") & ~F.col("na"), 1)).alias("n")
    full = base.filter("size < '4'").groupBy("block", "size", "race").agg(n)
    coarse = base.groupBy("block", "race").agg(n)
    margins = [Margin("full", full, ["block", "size", "race"], "n"), Margin("race", coarse, ["block", "race"], "n")]
    out = graft(base.drop("truth"), "o_orderkey", "family", margins, F.col("na"))
    return out.select("o_orderkey", "family", "family_flag")


# --- the flagship ------------------------------------------------------------


@query("entry_units_to_slots", f"""
WITH w AS (SELECT l_suppkey AS block, CASE l_returnflag WHEN 'A' THEN '003' WHEN 'N' THEN '004' ELSE '005' END AS code, count(*) AS n FROM lineitem GROUP BY 1, 2),
u AS (SELECT block, code, unnest(range(1, n + 1)) AS copy FROM w), k AS (SELECT *, block || '-' || code || '-' || copy AS pk FROM u),
h AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5(pk), pk) AS counter FROM k),
hk AS (SELECT *, block || 'H' || lpad(counter::VARCHAR, length((SELECT max(counter) FROM h)::VARCHAR)::INT, '0') AS huid FROM h),
a AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws('|', huid, {SEED})), huid) AS rk FROM hk),
s AS (SELECT (l_partkey + 19) // 20 AS s_block, line_key AS slot FROM {LINES_SQL}),
b AS (SELECT *, row_number() OVER (PARTITION BY s_block ORDER BY md5(concat_ws('|', slot, {SEED})), slot) AS rk FROM s),
m AS (SELECT code, CASE WHEN slot IS NULL THEN 'left_only' ELSE 'both' END AS merge_state FROM a LEFT JOIN b ON block = s_block AND a.rk = b.rk)
SELECT coalesce(code, 'Total') AS code, count(*) FILTER (merge_state = 'both') AS both, count(*) FILTER (merge_state = 'left_only') AS left_only, count(*) AS "Total" FROM m GROUP BY ROLLUP (code)""")
def entry_units_to_slots(t):
    flag = F.col("l_returnflag")
    wide = t.lineitem.groupBy(F.col("l_suppkey").alias("block")).agg(*[
        F.count(F.when(flag == f, 1)).alias(f"H016{c}") for f, c in (("A", "003"), ("N", "004"), ("R", "005"))])
    cells = reshape.unpivot_stem(wide, ["block"], "H016", "code", "n")
    opened = reshape.expand_rows(cells, "n", "copy").withColumn("pk", F.concat_ws("-", F.col("block").cast("string"), "code", F.col("copy").cast("string")))
    counted = random_rank(cut(opened.drop("copy")), ["block"], "pk", out="counter")
    largest = cells.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).scalar()
    hui = synthetic_key(counted, "counter", F.col("block"), "H", "huid", largest).select("huid", "block", "code")
    slot = lines(t, ids_only=True).select(F.expr("(l_partkey + 19) div 20").alias("s_block"), F.col("line_key").alias("slot"))
    merged = random_merge(Side(cut(hui), "huid"), Side(slot, "slot"), Round("block", [BLOCK]), SEED)
    table = tabulate.two_way(merged.filter("huid IS NOT NULL"), "code", "merge_state", ["both", "left_only"], F.count(F.lit(1)))
    return table
