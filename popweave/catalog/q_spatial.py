"""Points in polygons and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query
from popweave.catalog.standins import spot, spot_sql
from popweave.functions import geo
from popweave.operators.spatial import nearest, outlier_cutoff, point_in_polygon
from popweave.plans import links, places


def diamonds(t, radius=2.5):
    """One diamond per nation around the middle of its 4 x 4 grid field."""
    cx = (F.col("n_nationkey") % 5 * 4 + 2).cast("double")
    cy = (F.floor(F.col("n_nationkey") / 5) * 4 + 2).cast("double")
    ring = F.array(geo.point(cx - radius, cy), geo.point(cx, cy - radius), geo.point(cx + radius, cy), geo.point(cx, cy + radius))
    return t.nation.select("n_nationkey", "n_name", ring.alias("ring"))


def strips(t):
    """One vertical strip per region."""
    x = (F.col("r_regionkey") * 4).cast("double")
    return t.region.select("r_regionkey", "r_name", geo.rectangle(x, F.lit(0.0), x + 4, F.lit(20.0)).alias("ring"))


DIAMOND_SQL = "diamonds AS (SELECT n_nationkey, n_name, (n_nationkey % 5 * 4 + 2)::DOUBLE AS cx, (n_nationkey // 5 * 4 + 2)::DOUBLE AS cy FROM nation)"
IN_DIAMOND = "abs(x - cx) + abs(y - cy) <= 2.5"


def order_points(t):
    return t.orders.select("o_orderkey", spot(F.col("o_orderkey"), 71).alias("x"), spot(F.col("o_orderkey"), 89).alias("y"))


ORDER_POINTS_SQL = f"pts AS (SELECT o_orderkey, {spot_sql('o_orderkey', 71)} AS x, {spot_sql('o_orderkey', 89)} AS y FROM orders)"


def customer_points(t):
    return t.customer.select("c_custkey", F.col("c_nationkey").alias("cat"), spot(F.col("c_custkey"), 37).alias("x"), spot(F.col("c_custkey"), 53).alias("y"))


def supplier_points(t):
    return t.supplier.select("s_suppkey", F.col("s_nationkey").alias("cat"), spot(F.col("s_suppkey"), 71).alias("bx"), spot(F.col("s_suppkey"), 97).alias("by"))


CUST_SQL = f"a AS (SELECT c_custkey, c_nationkey AS cat, {spot_sql('c_custkey', 37)} AS x, {spot_sql('c_custkey', 53)} AS y FROM customer)"
SUPP_SQL = f"b AS (SELECT s_suppkey, s_nationkey AS cat, {spot_sql('s_suppkey', 71)} AS bx, {spot_sql('s_suppkey', 97)} AS \"by\" FROM supplier)"
DIST = 'sqrt((x - bx) * (x - bx) + (y - "by") * (y - "by"))'


@query("jn_10", f"""WITH {DIAMOND_SQL}, {ORDER_POINTS_SQL}, h AS (SELECT o_orderkey, min(n_nationkey) AS n_nationkey FROM pts JOIN diamonds ON {IN_DIAMOND} GROUP BY 1)
SELECT o_orderkey, h.n_nationkey, n_name FROM pts LEFT JOIN h USING (o_orderkey) LEFT JOIN nation ON h.n_nationkey = nation.n_nationkey""")
def jn_10(t):
    joined = point_in_polygon(order_points(t), "o_orderkey", "x", "y", diamonds(t), "n_nationkey", "ring", 1.0, ("n_name",))
    return joined.select("o_orderkey", "n_nationkey", "n_name")


@query("jn_10_all", f"WITH {DIAMOND_SQL}, {ORDER_POINTS_SQL} SELECT o_orderkey, n_nationkey FROM pts LEFT JOIN diamonds ON {IN_DIAMOND}")
def jn_10_all(t):
    joined = point_in_polygon(order_points(t), "o_orderkey", "x", "y", diamonds(t), "n_nationkey", "ring", 1.0, multi="all")
    return joined.select("o_orderkey", "n_nationkey")


# One square per nation with a square hole and a small square inside the hole, read from text.
@query("jn_10_parts", f"""WITH {DIAMOND_SQL}, {ORDER_POINTS_SQL}, d AS (SELECT o_orderkey, n_nationkey, greatest(abs(x - cx), abs(y - cy)) AS d FROM pts, diamonds),
h AS (SELECT o_orderkey, min(n_nationkey) AS n_nationkey FROM d WHERE d <= 0.5 OR d BETWEEN 1 AND 2 GROUP BY 1)
SELECT o_orderkey, h.n_nationkey, n_name FROM pts LEFT JOIN h USING (o_orderkey) LEFT JOIN nation ON h.n_nationkey = nation.n_nationkey""")
def jn_10_parts(t):
    cx, cy = F.col("n_nationkey") % 5 * 4 + 2, F.floor(F.col("n_nationkey") / 5) * 4 + 2
    square = lambda r: F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", (cx + a * r).cast("string"), (cy + b * r).cast("string"))
                                                               for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]), F.lit(")"))
    text = F.concat(F.lit("MULTIPOLYGON (("), square(2), F.lit(", "), square(1), F.lit("), ("), square(0.5), F.lit("))"))
    blocks = t.nation.select("n_nationkey", "n_name", geo.parse_rings(text).alias("rings"))
    joined = point_in_polygon(order_points(t), "o_orderkey", "x", "y", blocks, "n_nationkey", "rings", 1.0, ("n_name",))
    return joined.select("o_orderkey", "n_nationkey", "n_name")


@query("jn_11", f"""WITH {CUST_SQL}, {SUPP_SQL}
SELECT c_custkey, s_suppkey, {DIST} AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY {DIST}, s_suppkey) AS neighbor FROM a, b QUALIFY neighbor <= 3""")
def jn_11(t):
    return nearest(customer_points(t), "c_custkey", supplier_points(t), "s_suppkey", 3)


@query("jn_11_cutoff", f"""WITH {CUST_SQL}, {SUPP_SQL}
SELECT c_custkey, s_suppkey, {DIST} AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY {DIST}, s_suppkey) AS neighbor FROM a JOIN b ON {DIST} <= 1.5 QUALIFY neighbor <= 2""")
def jn_11_cutoff(t):
    return nearest(customer_points(t), "c_custkey", supplier_points(t), "s_suppkey", 2, 1.5)


@query("jn_11_outlier", f"""WITH {CUST_SQL}, {SUPP_SQL}, n AS (SELECT c_custkey, s_suppkey, {DIST} AS distance FROM a, b QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {DIST}, s_suppkey) = 1)
SELECT * FROM n WHERE distance <= (SELECT avg(distance) + 3 * stddev_samp(distance) FROM n)""")
def jn_11_outlier(t):
    return outlier_cutoff(nearest(customer_points(t), "c_custkey", supplier_points(t), "s_suppkey", 1)).drop("neighbor")


_NEAR_CAT = f"""near AS (SELECT c_custkey, s_suppkey, {DIST} AS distance FROM a JOIN b ON a.cat = b.cat QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {DIST}, s_suppkey) = 1)"""


@query("jn_12", f"""WITH {CUST_SQL}, {SUPP_SQL}, {_NEAR_CAT}
SELECT s_suppkey, c_custkey, distance FROM near QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, c_custkey) = 1""")
def jn_12(t):
    return links.link_nearest(customer_points(t), "c_custkey", supplier_points(t), "s_suppkey", ("cat",))


@query("jn_13", f"""WITH {CUST_SQL}, {SUPP_SQL}, c AS (SELECT p_partkey, {spot_sql('p_partkey', 13)} AS cx, {spot_sql('p_partkey', 29)} AS cy FROM part),
n1 AS (SELECT c_custkey, s_suppkey, {DIST} AS d FROM a JOIN b ON {DIST} <= 0.8 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY {DIST}, s_suppkey) = 1),
k1 AS (SELECT s_suppkey, c_custkey FROM n1 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) = 1),
m AS (SELECT concat_ws('-', a.c_custkey, b.s_suppkey) AS m_id, a.c_custkey AS a_id, b.s_suppkey AS b_id, coalesce(x, bx) AS x, coalesce(y, "by") AS y
  FROM (SELECT a.*, k1.s_suppkey FROM a LEFT JOIN k1 ON a.c_custkey = k1.c_custkey) a FULL JOIN b ON a.s_suppkey = b.s_suppkey),
n2 AS (SELECT m_id, p_partkey AS c_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS distance FROM m JOIN c ON sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= 0.8
  QUALIFY row_number() OVER (PARTITION BY m_id ORDER BY distance, c_id) = 1)
SELECT m.m_id, a_id, b_id, c_id, distance FROM m LEFT JOIN n2 ON m.m_id = n2.m_id""")
def jn_13(t):
    first = customer_points(t).select(F.col("c_custkey").alias("a_id"), "x", "y")
    second = supplier_points(t).select(F.col("s_suppkey").alias("b_id"), "bx", "by")
    third = t.part.select(F.col("p_partkey").alias("c_id"), spot(F.col("p_partkey"), 13).alias("cx"), spot(F.col("p_partkey"), 29).alias("cy"))
    return links.reconcile_points(first, second, third, 0.8).select("m_id", "a_id", "b_id", "c_id", "distance")


@query("jn_21", f"""WITH {DIAMOND_SQL}, {CUST_SQL}, p AS (SELECT c_custkey, min(n_nationkey) AS place FROM a JOIN diamonds ON {IN_DIAMOND} GROUP BY 1),
u AS (SELECT c_custkey, min(r_regionkey) AS puma FROM a JOIN region ON x BETWEEN r_regionkey * 4 AND r_regionkey * 4 + 4 GROUP BY 1)
SELECT a.c_custkey, place, puma FROM a LEFT JOIN p USING (c_custkey) LEFT JOIN u USING (c_custkey)""")
def jn_21(t):
    placed = diamonds(t).select(F.col("n_nationkey").alias("place"), "ring")
    pumas = strips(t).select(F.col("r_regionkey").alias("puma"), "ring")
    return places.blocks_with_places(customer_points(t), "c_custkey", placed, "place", pumas, "puma", "ring", 1.0).select("c_custkey", "place", "puma")


@query("pl_26", f"""WITH {DIAMOND_SQL}, {CUST_SQL}, z1 AS (SELECT c_custkey, min(n_nationkey) AS z FROM a JOIN diamonds ON {IN_DIAMOND} GROUP BY 1),
z2 AS (SELECT c_custkey, min(n_nationkey) AS z FROM a JOIN diamonds ON abs(x - cx) + abs(y - cy) <= 3 GROUP BY 1),
z3 AS (SELECT c_custkey, min(r_regionkey) AS z FROM a JOIN region ON x BETWEEN r_regionkey * 4 AND r_regionkey * 4 + 4 GROUP BY 1),
j AS (SELECT coalesce(z1.z::VARCHAR, 'missing') AS zone_1, coalesce(z2.z::VARCHAR, 'missing') AS zone_2, coalesce(z3.z::VARCHAR, 'missing') AS zone_3 FROM a LEFT JOIN z1 USING (c_custkey) LEFT JOIN z2 USING (c_custkey) LEFT JOIN z3 USING (c_custkey))
SELECT zone_1, zone_2, zone_3, count(*) AS blocks FROM j GROUP BY ALL""")
def pl_26(t):
    rows = customer_points(t)
    layers = [diamonds(t).select(F.col("n_nationkey").alias("z1"), "ring"), diamonds(t, 3.0).select(F.col("n_nationkey").alias("z2"), "ring"),
              strips(t).select(F.col("r_regionkey").alias("z3"), "ring")]
    for i, layer in enumerate(layers, 1):
        rows = point_in_polygon(rows, "c_custkey", "x", "y", layer, f"z{i}", "ring", 1.0)
    named = rows.select(*[F.coalesce(F.col(f"z{i}").cast("string"), F.lit("missing")).alias(f"zone_{i}") for i in (1, 2, 3)])
    return named.groupBy("zone_1", "zone_2", "zone_3").agg(F.count(F.lit(1)).alias("blocks"))
