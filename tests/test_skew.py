"""One group holds most rows: split paths must equal the plain window or join."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conftest import rows
from popweave.functions.seeded import order_key
from popweave.operators.groups import selection_probability
from popweave.operators.hot import hot_groups, spread_join
from popweave.operators.random_merge import Round, Side, merge_cascade
from popweave.operators.ranks import random_rank, value_rank
from popweave.operators.spatial import nearest, point_in_polygon
from popweave.functions.geo import rectangle


@pytest.fixture
def skewed(spark):
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 200).cast("string"))
    return spark.range(6000).select("id", g.alias("g"), (F.col("id") % 4).alias("s"), (F.col("id") * 37 % 1009).alias("v"))


def test_random_rank(skewed, paths):
    got = random_rank(skewed, ["g"], "id", 7, [("s", False)])
    want = skewed.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("s"), order_key("id", 7), "id")))
    assert rows(got, "id", "rank") == rows(want, "id", "rank")


def test_random_rank_without_sort(skewed, paths):
    got = random_rank(skewed, ["g"], "id", 7)
    want = skewed.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(order_key("id", 7), "id")))
    assert rows(got, "id", "rank") == rows(want, "id", "rank")


def test_random_rank_without_group(skewed, paths):
    got = random_rank(skewed, [], "id", 7)
    assert sorted(r[0] for r in got.select("rank").collect()) == list(range(1, 6001))


@pytest.mark.parametrize("down", [False, True])
def test_value_rank(skewed, paths, down):
    got = value_rank(skewed, ["g"], "v", ["id"], descending=down)
    first = F.col("v").desc() if down else F.col("v").asc()
    want = skewed.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(first, "id")))
    assert rows(got, "id", "rank") == rows(want, "id", "rank")


def test_one_value_of_a_hundred_thousand_rows(spark):
    df = spark.range(100_000).select("id", F.lit("g").alias("g"), F.lit(1.5).alias("v"), (F.col("id") % 50_000).alias("s"))
    got = value_rank(df, ["g"], "v", ["id"])
    assert got.filter(F.col("rank") != F.col("id") + 1).isEmpty() and got.count() == 100_000
    many = random_rank(df, ["g"], "id", 1, [("s", True)])
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy("s", order_key("id", 1), "id")))
    assert many.select("id", "rank").exceptAll(want.select("id", "rank")).isEmpty()
    per_task = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 50_000


def test_ranks_of_empty_tables_and_null_groups(spark):
    none = spark.createDataFrame([], "id long, g string, v long")
    assert value_rank(none, ["g"], "v", ["id"]).count() == 0 == random_rank(none, ["g"], "id").count()
    nulls = spark.range(300).select("id", F.lit(None).cast("string").alias("g"), F.lit(None).cast("long").alias("v"))
    for got in (value_rank(nulls, ["g"], "v", ["id"]), random_rank(nulls, ["g"], "id"), value_rank(nulls, ["g"], "id", descending=True)):
        assert sorted(r["rank"] for r in got.collect()) == list(range(1, 301))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, skewed, paths, how):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), ("7", 4)], "g string, w int")
    got = spread_join(skewed, small, ["g"], how)
    assert rows(got) == rows(skewed.join(small, "g", how).select(*got.columns))


def test_hot_groups_are_bounded(spark, skewed):
    spark.conf.set("popweave.spread", "40")
    sizes = skewed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_groups(sizes, ["g"], "n").collect()
    spark.conf.unset("popweave.spread")
    assert 0 < len(hot) < 40 and sum(r["_pieces"] for r in hot) <= 80


def test_probability(skewed, paths):
    got = selection_probability(skewed, ["g"], "s")
    w = lambda *k: F.count(F.lit(1)).over(W.partitionBy(*k))
    want = skewed.withColumn("prob_selected", w("g", "s") / w("g"))
    assert rows(got, "id", "prob_selected") == rows(want, "id", "prob_selected")


def test_cascade_is_one_to_one_and_loses_nothing(spark, paths):
    p = spark.range(400).select(F.col("id").alias("p"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 20).alias("b"), F.when(F.col("id") % 9 != 0, F.col("id") % 3).alias("c"))
    s = spark.range(300).select(F.col("id").alias("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 25).alias("sb"), (F.col("id") % 4).alias("sc"))
    rounds = [Round("bc", [("b", "b", "sb"), ("c", "c", "sc")]), Round("b", [("b", "b", "sb")]), Round("all", [])]
    out = merge_cascade(Side(p, "p"), Side(s, "s"), rounds, 5)
    pairs = out.pairs.collect()
    assert len({r["p"] for r in pairs}) == len(pairs) == len({r["s"] for r in pairs}) == 300
    assert out.primary_left.count() == 100 and out.secondary_left.count() == 0
    left = {r["p"] for r in out.primary_left.collect()}
    assert left | {r["p"] for r in pairs} == set(range(400))


def test_cascade_same_result_for_any_partitioning(spark):
    p = spark.range(300).select(F.col("id").alias("p"), (F.col("id") % 7).alias("b"))
    s = spark.range(200).select(F.col("id").alias("s"), (F.col("id") % 5).alias("sb"))
    got = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(merge_cascade(Side(p, "p"), Side(s, "s"), [Round("b", [("b", "b", "sb")]), Round("all", [])], 5).pairs))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]


@pytest.mark.parametrize("reuse", ["modulo", "cycles"])
def test_reuse_gives_every_row_a_partner(spark, reuse):
    p = spark.range(100).select(F.col("id").alias("p"), (F.col("id") % 2).alias("b"))
    s = spark.range(14).select(F.col("id").alias("s"), (F.col("id") % 2).alias("sb"))
    out = merge_cascade(Side(p, "p"), Side(s, "s"), [Round("b", [("b", "b", "sb")])], 5, reuse=reuse)
    pairs = out.pairs.collect()
    assert sorted(r["p"] for r in pairs) == list(range(100))
    assert all(r["p"] % 2 == r["s"] % 2 for r in pairs)
    uses = [sum(1 for r in pairs if r["s"] == k) for k in range(14)]
    assert max(uses) - min(uses) <= 1


def test_nearest_leaves_out_rows_without_a_place(spark, paths):
    from popweave.plans.links import link_nearest
    a = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None), (3, None, None), (4, 1.0, 1.0)], "a int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 2.0), (2, 5.0, 5.0), (3, None, 1.0)], "b int, bx double, by double")
    assert rows(nearest(a, "a", b, "b", 2), "a", "b") == [(4, 1), (4, 2)]
    assert rows(link_nearest(a, "a", b, "b", k=2), "b", "a") == [(1, 4), (2, 4)]


def test_nearest_brute_force_with_dense_spot(spark, paths):
    a = [(i, (i * 37 % 101) / 10.0, (i * 53 % 103) / 10.0) for i in range(60)] + [(100 + i, 5.0, 5.0) for i in range(20)]
    b = [(i, (i * 71 % 97) / 9.0, (i * 13 % 89) / 8.0) for i in range(40)] + [(100 + i, 5.0, 5.0) for i in range(30)] + [(999, 900.0, 900.0)]
    got = rows(nearest(spark.createDataFrame(a, "a int, x double, y double"), "a", spark.createDataFrame(b, "b int, bx double, by double"), "b", 3), "a", "neighbor", "b")
    want = []
    for i, x, y in a:
        order = sorted((((x - bx) * (x - bx) + (y - by) * (y - by)) ** 0.5, j) for j, bx, by in b)[:3]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(order)]
    assert got == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))


def test_polygons_of_very_different_size(spark, paths):
    polys = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0), (2, 3.0, 3.0, 3.5, 3.5), (3, 990.0, 990.0, 1010.0, 1010.0)], "k int, a double, b double, c double, d double")
    polys = polys.select("k", rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("ring"))
    pts = spark.createDataFrame([(1, 3.2, 3.2), (2, 995.0, 995.0), (3, 1005.0, 1005.0), (4, 2000.0, 0.0), (5, 1000.0, 500.0)], "p int, x double, y double")
    got = rows(point_in_polygon(pts, "p", "x", "y", polys, "k", "ring", 1.0, multi="all"), "p", "k")
    assert got == [(1, 1), (1, 2), (2, 1), (2, 3), (3, 3), (4, None), (5, 1)]


def _brute_inside(rings, x, y):
    crossings = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                crossings += 1
    return crossings % 2 == 1


def test_polygons_with_holes_and_parts(spark, paths):
    import math
    r = random.Random(2)
    star = [(10 + (8 if i % 2 else 3) * math.cos(i * math.pi / 100), 10 + (8 if i % 2 else 3) * math.sin(i * math.pi / 100)) for i in range(200)]
    comb = [p for i in range(30) for p in ((i * 0.5, 0.0), (i * 0.5 + 0.25, 15.0))] + [(15.0, -1.0), (0.0, -1.0)]
    shapes = {1: [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (2, 6), (6, 6), (6, 2)], [(3, 3), (5, 3), (5, 5), (3, 5)]], 2: [star], 3: [comb],
              4: [[(30, 30), (31, 30), (31, 31)], [(40, 40), (44, 40), (40, 44)]], 5: [[(0, 20), (5, 20), (9, 20)]]}
    pts = [(i, r.uniform(-2, 20), r.uniform(-2, 20)) for i in range(400)] + [(900 + i, float(i % 9), float(i // 9)) for i in range(81)]
    pts += [(2000, 30.9, 30.1), (2001, 41.0, 41.0), (2002, 35.0, 35.0), (2003, 4.0, 20.0), (2004, None, 1.0), (2005, 1.0, None)]
    polys = spark.createDataFrame([(k, [[{"x": float(a), "y": float(b)} for a, b in ring] for ring in v], "n") for k, v in shapes.items()] + [(6, None, "n"), (7, [], "n")],
                                  "k int, rings array<array<struct<x: double, y: double>>>, name string")
    got = point_in_polygon(spark.createDataFrame(pts, "p int, x double, y double"), "p", "x", "y", polys, "k", "rings", 1.0, ("name",), multi="all")
    want = []
    for p, x, y in pts:
        held = [k for k, v in shapes.items() if x is not None and y is not None and _brute_inside(v, x, y)]
        want += [(p, k) for k in held] or [(p, None)]
    assert rows(got, "p", "k") == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
    one_row_a_ring = polys.select("k", F.explode("rings").alias("ring"))
    again = point_in_polygon(spark.createDataFrame(pts, "p int, x double, y double"), "p", "x", "y", one_row_a_ring, "k", "ring", 1.0, multi="all")
    assert rows(again, "p", "k") == rows(got, "p", "k")


def test_a_point_meets_the_edges_of_its_band(spark):
    import math
    from popweave.operators import spatial
    ring = [{"x": 100 * math.cos(i * math.pi / 5000), "y": 100 * math.sin(i * math.pi / 5000)} for i in range(10000)]
    polys = spark.createDataFrame([(1, ring)], "k int, ring array<struct<x: double, y: double>>")
    edges = spatial.polygon_edges(polys, "k", "ring")
    banded = edges.join(spatial.polygon_boxes(edges, "k", 1.0), "k").withColumn(
        "b", F.explode(F.sequence(spatial._band(F.least("ay", "by")), spatial._band(F.greatest("ay", "by")))))
    sizes = [r["count"] for r in banded.groupBy("b").count().collect()]
    assert edges.count() == 10000 and sum(sizes) < 25000 and sorted(sizes)[len(sizes) // 2] <= 8


@pytest.mark.parametrize("rings", [
    [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 2), (4, 2), (4, 3), (0, 3)]],
    [[(0, 0), (8, 0), (8, 8), (0, 8)], [(1, 1), (1, 7), (7, 7), (7, 1)]],
    [[(0, 0), (1, 0), (1, 1)], [(10, 5), (14, 5), (10, 9)]],
    [[(0, 0), (5, 5), (10, 0), (5, 9)]]])
def test_inner_point_is_inside(spark, rings):
    from popweave.functions.geo import inner_point, inside_rings
    df = spark.createDataFrame([([[{"x": float(a), "y": float(b)} for a, b in ring] for ring in rings],)], "r array<array<struct<x: double, y: double>>>")
    p = df.select(inner_point(F.col("r")).alias("p")).select("p.x", "p.y").first()
    assert _brute_inside(rings, p["x"], p["y"])
    assert df.select(inside_rings(F.col("r"), F.lit(p["x"]), F.lit(p["y"])).alias("i")).first()["i"]


def test_flat_and_missing_polygons_have_no_inner_point(spark):
    from popweave.functions.geo import inner_point, parse_rings
    texts = spark.createDataFrame([("POLYGON ((0 0, 1 0, 2 0, 0 0))",), ("POLYGON EMPTY",), (None,), ("POINT (1 2)",), ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5 5, 5 5, 5 5, 5 5)))",)], "w string")
    got = [(r["n"], None if r["p"] is None else tuple(r["p"])) for r in texts.select(parse_rings(F.col("w")).alias("r")).select(
        F.size("r").alias("n"), inner_point(F.col("r")).alias("p")).collect()]
    assert [g[0] for g in got] == [1, 0, None, None, 3] and [g[1] is None for g in got] == [True, True, True, True, False]


def test_one_partner_serves_hundreds(spark):
    p = spark.range(300).select(F.col("id").alias("p"), (F.col("id") % 2).alias("b"), F.lit(1).alias("c"))
    s = spark.createDataFrame([(1, 0, 1)], "s int, sb int, sc int")
    rounds = [Round("b", [("b", "b", "sb")], "fine"), Round("c", [("c", "c", "sc")], "coarse")]
    out = merge_cascade(Side(p, "p"), Side(s, "s"), rounds, 5, reuse="cycles")
    assert sorted(r["p"] for r in out.pairs.collect()) == list(range(300)) and out.primary_left.isEmpty()


def test_zero_weights_are_never_drawn(spark):
    from popweave.operators.select import weighted_sample
    df = spark.createDataFrame([(i, i % 2, 0.0 if i % 3 else 1.0) for i in range(60)] + [(99, 0, None)], "k int, g int, w double")
    got = weighted_sample(df, ["g"], "k", "w", 25, 3).collect()
    assert sorted(r["k"] for r in got) == [i for i in range(60) if i % 3 == 0]


def test_pieces_are_even_wherever_the_values_lie(spark):
    from popweave.operators.hot import piece_of, value_limits
    spark.conf.set("popweave.spread", "40")
    df = spark.range(20000).select(F.lit(1).alias("g"), (F.col("id") / 1e9).alias("v")).unionByName(
        spark.createDataFrame([(1, 1e12), (1, -1e12), (1, None)], "g int, v double"))
    hot = hot_groups(df.groupBy("g").count(), ["g"], "count")
    cut_up = df.join(value_limits(df, hot, ["g"], F.col("v")), "g").groupBy(piece_of(F.col("v"))).count()
    sizes = [r["count"] for r in cut_up.collect()]
    assert len(sizes) == 40 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    spark.conf.unset("popweave.spread")


@pytest.mark.parametrize("k", [1, 3])
def test_far_rows_do_not_meet_a_whole_dense_place(spark, k):
    import random
    r = random.Random(4)
    targets = [(i, 500 + r.gauss(0, 1), 500 + r.gauss(0, 1)) for i in range(2000)] + [(9000, 0.0, 1000.0)]
    far = [(i, r.uniform(0, 60), r.uniform(0, 60)) for i in range(300)]
    near = nearest(spark.createDataFrame(far, "a int, x double, y double"), "a", spark.createDataFrame(targets, "b int, bx double, by double"), "b", k)
    got = {(r["a"], r["neighbor"]): r["b"] for r in near.collect()}
    for i, x, y in far:
        order = sorted(((x - bx) ** 2 + (y - by) ** 2, j) for j, bx, by in targets)[:k]
        assert [got[i, n + 1] for n in range(k)] == [j for _, j in order]
