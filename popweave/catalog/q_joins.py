"""Equi joins, null-safe joins, aligned arithmetic, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query
from popweave.catalog.standins import money
from popweave.operators import joins
from popweave.operators.hot import lookup


@query("jn_01", """
SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey * 2""")
def jn_01(t):
    c = t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name")
    return lookup(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey", "left").select("o_orderkey", "c_name")


@query("jn_02", """
SELECT l_orderkey, l_linenumber, o_orderstatus, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def jn_02(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", o, "o_orderkey")


@query("jn_03", """
WITH s AS (SELECT o_custkey * 2 AS o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, n FROM s RIGHT JOIN customer ON o_custkey = c_custkey""")
def jn_03(t):
    counts = t.orders.groupBy((F.col("o_custkey") * 2).alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return joins.checked_join(counts.withColumnRenamed("o_custkey", "c_custkey"), t.customer.select("c_custkey"), ["c_custkey"], "one_to_one", "right").select("c_custkey", "n")


@query("jn_04", """
WITH a AS (SELECT l_partkey * 2 AS l_partkey, count(*) AS units FROM lineitem GROUP BY 1), b AS (SELECT p_partkey, p_size FROM part)
SELECT coalesce(l_partkey, p_partkey) AS partkey, coalesce(units, 0) AS units, coalesce(p_size, 0) AS p_size FROM a FULL JOIN b ON l_partkey = p_partkey""")
def jn_04(t):
    a = t.lineitem.groupBy((F.col("l_partkey") * 2).alias("partkey")).agg(F.count(F.lit(1)).alias("units"))
    b = t.part.select(F.col("p_partkey").alias("partkey"), "p_size")
    return a.join(b, "partkey", "full").fillna(0, ["units", "p_size"])


@query("jn_05", """
WITH a AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey END AS k, count(*) AS left_n FROM lineitem GROUP BY 1),
b AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey * 2 END AS k, count(*) AS right_n FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, left_n, right_n, CASE WHEN left_n IS NOT NULL AND right_n IS NOT NULL THEN 'both' WHEN left_n IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge_state
FROM a FULL JOIN b ON coalesce(a.k, -1) = coalesce(b.k, -1)""")
def jn_05(t):
    side = lambda df, key, times, n: df.groupBy(F.when(F.col(key) % 50 != 0, F.col(key) * times).alias("k")).agg(F.count(F.lit(1)).alias(n))
    return joins.outer_indicator(side(t.lineitem, "l_partkey", 1, "left_n"), side(t.orders, "o_custkey", 2, "right_n"), ["k"], kind="one_to_one")


@query("jn_06", "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def jn_06(t):
    return joins.duplicate_keys(t.lineitem, ["l_partkey", "l_suppkey"])


@query("jn_09", """
WITH a AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(concat_ws('|', l_orderkey * 8 + l_linenumber)), l_orderkey * 8 + l_linenumber, l_partkey) - 1 AS slot FROM lineitem),
b AS (SELECT p_partkey, s_suppkey AS l_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY md5(concat_ws('|', p_partkey)), p_partkey) - 1 AS slot FROM part JOIN supplier ON s_suppkey = p_partkey % 100)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.slot, b.slot) AS slot, p_partkey, count(l_orderkey) AS rows FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.slot = b.slot GROUP BY ALL""")
def jn_09(t):
    left = t.lineitem.select("l_suppkey", "l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    right = t.part.join(t.supplier, F.col("s_suppkey") == F.col("p_partkey") % 100).select(F.col("s_suppkey").alias("l_suppkey"), "p_partkey")
    paired = joins.slot_join(left, right, ["l_suppkey"], "line", "p_partkey")
    return paired.groupBy("l_suppkey", "slot", "p_partkey").agg(F.count("l_orderkey").alias("rows"))


@query("jn_14", """
WITH b AS (SELECT n_nationkey AS code, n_nationkey * 4.0::DOUBLE AS lo, n_nationkey * 4.0::DOUBLE + 5 AS hi FROM nation)
SELECT event_id, value, max(code) AS code FROM events LEFT JOIN b ON value BETWEEN lo AND hi GROUP BY 1, 2""")
def jn_14(t):
    low = F.col("n_nationkey") * 4.0
    bands = t.nation.select(F.col("n_nationkey").alias("code"), low.alias("lo"), (low + 5).alias("hi"))
    return joins.range_lookup(t.events.select("event_id", "value"), "value", bands, "lo", "hi", "code", 5.0)


@query("jn_15", """
SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey""")
def jn_15(t):
    p = t.part.select("p_partkey", "p_brand", "p_type")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return lookup(rows, "l_partkey", p, "p_partkey").select("l_orderkey", "l_linenumber", "p_brand", "p_type")


@query("jn_17", """
SELECT s_suppkey, 'inside' AS side FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)
UNION ALL SELECT s_suppkey, 'outside' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)""")
def jn_17(t):
    used = t.lineitem.filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    keys = t.supplier.select("s_suppkey")
    return (keys.join(used, "s_suppkey", "left_semi").withColumn("side", F.lit("inside"))
            .unionByName(keys.join(used, "s_suppkey", "left_anti").withColumn("side", F.lit("outside"))))


@query("jn_18", """
WITH a AS (SELECT l_partkey, count(*) AS n, sum(l_quantity::DECIMAL(18,2)) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey * 7 AS l_partkey, count(*) AS n, sum(l_quantity::DECIMAL(18,2)) AS q FROM lineitem GROUP BY 1)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.n, 0) - coalesce(b.n, 0) AS n, (coalesce(a.q, 0) - coalesce(b.q, 0))::DOUBLE AS q FROM a FULL JOIN b ON a.l_partkey = b.l_partkey""")
def jn_18(t):
    counts = lambda key: t.lineitem.groupBy(key.alias("l_partkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).alias("q"))
    out = joins.subtract_tables(counts(F.col("l_partkey")), counts(F.col("l_suppkey") * 7), ["l_partkey"], ["n", "q"])
    return out.withColumn("q", F.col("q").cast("double"))


@query("jn_19", """
WITH f AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS first FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN first THEN c_nationkey ELSE 0 END AS c_nationkey FROM f JOIN customer ON o_custkey = c_custkey""")
def jn_19(t):
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return joins.first_row_join(t.orders.select("o_orderkey", "o_custkey"), right, "o_custkey", "o_orderkey", ["c_nationkey"])


@query("jn_20", """
SELECT l_partkey, l_returnflag, count(*) FILTER (year(l_shipdate) % 2 = 0) AS n_0, count(*) FILTER (year(l_shipdate) % 2 = 1) AS n_1,
  least(count(*) FILTER (year(l_shipdate) % 2 = 0), count(*) FILTER (year(l_shipdate) % 2 = 1)) AS matched FROM lineitem GROUP BY 1, 2""")
def jn_20(t):
    rows = t.lineitem.select("l_partkey", "l_returnflag", (F.year("l_shipdate") % 2).alias("year"))
    return joins.outer_compare(rows, ["l_partkey", "l_returnflag"], "year", [0, 1])


@query("jn_22", """
SELECT l_orderkey, l_linenumber, s_nationkey AS work_nation, c_nationkey AS home_nation FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey""")
def jn_22(t):
    home = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("home_nation"))
    work = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("work_nation"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    both = lookup(lookup(rows, "l_suppkey", work, "s_suppkey", "left"), "l_orderkey", home, "o_orderkey", "left")
    return both.select("l_orderkey", "l_linenumber", "work_nation", "home_nation")


@query("jn_24", """
SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25""")
def jn_24(t):
    pole = t.part.filter("p_size > 25").select("p_partkey", "p_name")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return lookup(rows, "l_partkey", pole, "p_partkey").select("l_orderkey", "l_linenumber", "p_name")


# --- set operations ---------------------------------------------------------


@query("st_01", """
SELECT c_custkey AS key, c_name AS name, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def st_01(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return a.unionByName(b, allowMissingColumns=True)


@query("st_02", """
SELECT 'wac' AS od, l_suppkey AS geocode, count(*) AS jobs FROM lineitem GROUP BY 2 UNION ALL SELECT 'rac', o_custkey, count(*) FROM orders GROUP BY 2""")
def st_02(t):
    wac = t.lineitem.groupBy(F.col("l_suppkey").alias("geocode")).agg(F.count(F.lit(1)).alias("jobs")).withColumn("od", F.lit("wac"))
    rac = t.orders.groupBy(F.col("o_custkey").alias("geocode")).agg(F.count(F.lit(1)).alias("jobs")).withColumn("od", F.lit("rac"))
    return wac.unionByName(rac).orderBy("od", "geocode")


@query("st_03", """
SELECT l_partkey FROM lineitem INTERSECT SELECT o_custkey * 2 FROM orders INTERSECT SELECT p_partkey * 3 FROM part""")
def st_03(t):
    return t.lineitem.select("l_partkey").intersect(t.orders.select(F.col("o_custkey") * 2)).intersect(t.part.select(F.col("p_partkey") * 3))


@query("st_04", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def st_04(t):
    used = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(used, "c_custkey", "left_anti")


@query("st_05", """
SELECT coalesce(l_suppkey::VARCHAR, 'Total') AS block, count(*) AS jobs, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY ROLLUP (l_suppkey)""")
def st_05(t):
    from popweave.operators.tabulate import margins
    rows = t.lineitem.select(F.col("l_suppkey").alias("block"), money("l_quantity").alias("q"))
    return margins(rows, ["block"], jobs=F.count(F.lit(1)), quantity=F.sum("q").cast("double"))
