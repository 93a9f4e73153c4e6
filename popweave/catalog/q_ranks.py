"""Counters, keys, first rows, capacity-bound draws, sorts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query
from popweave.catalog.standins import SLOTS_SQL, slots, u_sql
from popweave.operators import profile, ranks, select
from popweave.operators.groups import with_group_stats
from popweave.session import cut


@query("wn_01", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS counter FROM orders")
def wn_01(t):
    return ranks.value_rank(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", out="counter")


@query("wn_02", """
WITH c AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS counter FROM orders)
SELECT o_orderkey, o_custkey || 'H' || lpad(counter::VARCHAR, length((SELECT max(counter) FROM c)::VARCHAR)::INT, '0') AS huid FROM c""")
def wn_02(t):
    counted = ranks.value_rank(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", out="counter")
    largest = ranks.largest_group(t.orders, ["o_custkey"])
    return ranks.synthetic_key(counted, "counter", F.col("o_custkey"), "H", "huid", largest).select("o_orderkey", "huid")


@query("wn_03", f"""
WITH {SLOTS_SQL}, k AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE block END AS grp FROM slots)
SELECT o_orderkey, grp, row_number() OVER (PARTITION BY grp ORDER BY o_orderstatus, md5(concat_ws('|', o_orderkey, 42)), o_orderkey) AS random_order FROM k""")
def wn_03(t):
    keyed = slots(t).select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("block")).alias("grp"))
    return ranks.random_rank(keyed, ["grp"], "o_orderkey", 42, [("o_orderstatus", True)], "random_order").select("o_orderkey", "grp", "random_order")


@query("wn_04", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey)), l_orderkey, l_linenumber, l_partkey) AS counter FROM lineitem""")
def wn_04(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    # Rows of equal keys agree in all columns, so it does not matter which of them comes first.
    return ranks.random_rank(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], None, [("l_discount", False)], "counter").select(
        "l_orderkey", "l_linenumber", "counter")


@query("wn_05", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY md5(concat_ws('|', o_orderkey, 7)), o_orderkey) AS f FROM orders),
s AS (SELECT *, CASE WHEN f = 1 OR o_totalprice > 490000 THEN 1 ELSE 0 END AS sel, count(*) OVER (PARTITION BY o_custkey) // 2 AS want FROM c),
h AS (SELECT *, sum(sel) OVER (PARTITION BY o_custkey) AS have FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, sel ORDER BY md5(concat_ws('|', o_orderkey, 7)), o_orderkey) AS turn FROM h)
SELECT o_orderkey, o_custkey, CASE WHEN have = want THEN sel WHEN sel = 1 AND turn > want THEN 0 WHEN sel = 0 AND turn <= want - have THEN 1 ELSE sel END AS select_job FROM r""")
def wn_05(t):
    rows = with_group_stats(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), ["o_custkey"],
                            want=F.floor(F.count(F.lit(1)) / 2))
    picked = select.select_jobs(cut(rows), ["o_custkey", "o_orderpriority"], ["o_custkey"], "o_orderkey", "want", F.col("o_totalprice") > 490000, 7)
    return picked.select("o_orderkey", "o_custkey", "select_job")


@query("wn_06", """
WITH c AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey, n AS huicounter1, n AS huicounter2, n AS huicounter3 FROM c""")
def wn_06(t):
    counted = ranks.value_rank(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", out="n")
    return counted.select("o_orderkey", *[F.col("n").alias(f"huicounter{i}") for i in (1, 2, 3)])


@query("wn_07", """
SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) = 1""")
def wn_07(t):
    return ranks.first_per_group(t.lineitem, ["l_partkey"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"], ["l_suppkey", "l_orderkey"])


@query("wn_08", """
WITH d AS (SELECT p_partkey, p_size, p_brand, sum(p_size) OVER (PARTITION BY p_brand) AS area, count(*) OVER (PARTITION BY p_brand) * 3 AS residual FROM part)
SELECT p_partkey, round_even(p_size / area::DOUBLE * residual, 0)::BIGINT AS added FROM d""")
def wn_08(t):
    rows = with_group_stats(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], area=F.sum("p_size"), residual=F.count(F.lit(1)) * 3)
    return rows.select("p_partkey", F.bround(F.col("p_size") / F.col("area") * F.col("residual"), 0).cast("bigint").alias("added"))


@query("wn_09", """
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 1 ELSE 0 END AS is_first FROM orders""")
def wn_09(t):
    # The first key of each group is an aggregate; only first rows find a partner.
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key")).select("first_key", F.lit(1).alias("hit"))
    return t.orders.select("o_orderkey").join(first, F.col("o_orderkey") == F.col("first_key"), "left").select(
        "o_orderkey", F.coalesce("hit", F.lit(0)).alias("is_first"))


@query("so_01", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
def so_01(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


@query("so_02", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 3""")
def so_02(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks.top_k(rows, ["l_suppkey"], [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("so_03", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def so_03(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query("so_04", f"""
WITH {SLOTS_SQL}, d AS (SELECT o_orderkey, block, -ln(greatest({u_sql('o_orderkey', 11)}, 2.220446049250313e-16)) / o_totalprice AS draw FROM slots),
r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY draw, o_orderkey) AS take FROM d) SELECT o_orderkey, block FROM r WHERE take <= 20""")
def so_04(t):
    return select.weighted_sample(slots(t).select("o_orderkey", "block", "o_totalprice"), ["block"], "o_orderkey", "o_totalprice", 20, 11).select("o_orderkey", "block")


@query("so_05", """
SELECT url FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) ORDER BY md5(concat_ws('|', url, 42)), url LIMIT 4""")
def so_05(t):
    return profile.examples(t.pages, "url", 42)


@query("so_06", """
WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') // 3 AS m FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, 5)), l_orderkey, l_linenumber, l_partkey) AS take FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, r.l_suppkey FROM r JOIN c ON r.l_suppkey = c.l_suppkey WHERE take <= m""")
def so_06(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    capacity = t.lineitem.groupBy("l_suppkey").agg(F.floor(F.count(F.when(F.col("l_returnflag") == "R", 1)) / 3).alias("m"))
    return select.draw_per_group(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], capacity, "m", 5)
