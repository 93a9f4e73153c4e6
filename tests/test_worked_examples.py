"""Hand-worked rows: input and exact expected output."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from popweave.functions import bands, geo, label_text, labels
from popweave.functions.seeded import order_key, random_int, uniform
from popweave.operators import joins, ranks, reshape, tabulate
from popweave.operators.graft import Margin, graft
from popweave.operators.groups import exact_quantiles, group_sum, with_group_stats
from popweave.operators.random_merge import Round, Side, random_merge
from popweave.plans.inventory import base_inventory


def test_unpivot_expand_number_key(spark, paths):
    wide = spark.createDataFrame([("B1", 2, 0, 1)], "block string, H016003 int, H016004 int, H016005 int")
    long = reshape.unpivot_stem(wide, ["block"], "H016", "code", "n")
    assert rows(long) == [("B1", "003", 2), ("B1", "005", 1)]
    units = base_inventory([long.select("block", "code", "n")], "block", "n", "H", "huid")
    assert rows(units, "huid", "code") == [("B1H1", "003"), ("B1H2", "003"), ("B1H3", "005")]


def test_key_width_follows_largest_counter(spark):
    df = spark.range(1, 13).select(F.lit("B1").alias("b"), F.col("id").alias("n"))
    keys = [r[0] for r in rows(ranks.synthetic_key(df, "n", F.col("b"), "H", "k"), "k")]
    assert keys[0] == "B1H01" and keys[-1] == "B1H12"


def test_key_aligned_subtraction(spark):
    a = spark.createDataFrame([("B1", 5), ("B2", 3)], "b string, n int")
    i = spark.createDataFrame([("B1", 2)], "b string, n int")
    assert rows(joins.subtract_tables(a, i, ["b"], ["n"])) == [("B1", 3), ("B2", 3)]


def test_random_merge_order(spark, paths):
    units = spark.createDataFrame([("h1", "b1"), ("h2", "b1"), ("h3", "b1")], "h string, b string")
    slots = spark.createDataFrame([("a1", "b1"), ("a2", "b1")], "a string, sb string")
    merged = random_merge(Side(units, "h"), Side(slots, "a"), Round("b", [("b", "b", "sb")]), 42)
    assert rows(merged, "h", "a", "merge_state") == [("h1", None, "left_only"), ("h2", "a2", "both"), ("h3", "a1", "both")]
    got = units.select(F.substring(order_key("h", 42), 1, 8)).collect()
    assert [r[0] for r in got] == ["f3616d5e", "68ddcba6", "72683c07"]
    u = [r[0] for r in units.select(uniform("h", 42)).collect()]
    assert u[0] == pytest.approx(0.9507053715209985, abs=1e-15) and u[1] == pytest.approx(0.4096343308759409, abs=1e-15)


def test_null_keys_match(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, r string")
    assert [r[-1] for r in rows(joins.outer_indicator(a, b, ["k"]), "k", "merge_state")] == ["both", "both"]


@pytest.mark.parametrize("count,ones", [(3, 3), (0, 0), (2, 2)])
def test_graft_one_block(spark, paths, count, ones):
    units = spark.createDataFrame([(i, "b", -999) for i in range(3)], "h int, b string, fam int")
    counts = spark.createDataFrame([("b", count)], "b string, n int")
    out = graft(units, "h", "fam", [Margin("t", counts, ["b"], "n")])
    assert sorted(r[0] for r in out.select("fam").collect()) == [0] * (3 - ones) + [1] * ones


def test_graft_keeps_given_and_skips_not_applicable(spark):
    units = spark.createDataFrame([(1, "b", 1, False), (2, "b", 0, False), (3, "b", -999, True), (4, None, -999, False)], "h int, b string, fam int, vac boolean")
    counts = spark.createDataFrame([("b", 5)], "b string, n int")
    out = graft(units, "h", "fam", [Margin("t", counts, ["b"], "n")], F.col("vac"))
    assert rows(out, "h", "fam") == [(1, 1), (2, 0), (3, None), (4, 1)]


def test_block_error_codes(spark):
    cases = [(0, 0, 1, 1), (3, 3, 2, 2), (2, 5, 4, 3), (4, 0, None, 8), (4, 0, 0, 9), (4, 0, 2, 5), (4, 2, 2, 4), (4, None, 2, 6)]
    df = spark.createDataFrame(cases, "e int, a int, b int, want int")
    assert df.filter(labels.block_error_code(F.col("e"), F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_residual_shared_by_area_half_even(spark):
    df = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "id int, area int").withColumn("g", F.lit(1))
    shared = group_sum(df, ["g"], "area", "total").select("id", F.bround(F.col("area") / F.col("total") * 3, 0).cast("int"))
    assert rows(shared) == [(1, 0), (2, 1), (3, 2)]


def test_job_expansion(spark):
    df = spark.createDataFrame([("b", 1, 2), ("b", 2, 5), ("c", 3, 4), ("d", 4, -2), ("e", 5, 1), ("e", 6, 1)], "block string, id int, n int")
    counted = reshape.job_expand_count(df, ["block"], "n")
    assert rows(counted, "id", "copies") == [(1, 1), (2, 3), (3, 4), (4, 1), (5, 1), (6, 1)]


def test_expand_large_count_spreads(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 1), ("c", 0), ("d", -3)], "k string, n int")
    out = reshape.expand_rows(df, "n", "i").groupBy("k").agg(F.count("*"), F.min("i"), F.max("i"), F.count_distinct("i"))
    assert rows(out) == [("a", 25_001, 1, 25_001, 25_001), ("b", 1, 1, 1, 1)]


def test_great_circle(spark):
    km = spark.range(1).select(geo.great_circle_km(F.lit(53.32055555555556), F.lit(53.31861111111111), F.lit(-1.7297222222222221), F.lit(-1.6997222222222223)))
    assert km.first()[0] == pytest.approx(2.0043678382716137, abs=1e-9)


def test_bands_income_poverty(spark):
    df = spark.createDataFrame([(25, 14999, 23491), (25, 15000, 23492)], "age int, inc int, pov int")
    none = F.lit(0)
    got = df.select(bands.band(F.col("age"), bands.AGE_B19037), bands.income_group(F.col("inc"), none, none), bands.poverty(F.col("pov"), F.lit(4), none, none))
    assert rows(got) == [(2, 1, 1), (2, 2, 0)]


def test_band_lookup_table_edges(spark):
    ages = spark.range(-2, 115).select(F.col("id").alias("a"))
    got = {r[0]: r[1] for r in ages.select("a", bands.band(F.col("a"), bands.AGE_P12)).collect()}
    want = {a: next((c for c, lo, hi in reversed(bands.AGE_P12) if lo <= a <= hi), None) for a in range(-2, 115)}
    assert got == want


def test_point_in_square(spark):
    ring = geo.rectangle(F.lit(0), F.lit(0), F.lit(2), F.lit(2))
    df = spark.createDataFrame([(1.0, 1.0, True), (2.0, 1.0, True), (3.0, 1.0, False), (0.0, 0.0, True), (-1.0, 0.0, False)], "x double, y double, want boolean")
    assert df.filter(geo.inside(ring, F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_last_and_first_match(spark):
    v = F.lit(0.7)
    rules = [(v > 0, F.lit(">0")), (v > 0.2, F.lit(">.2")), (v > 0.4, F.lit(">.4")), (v > 0.6, F.lit(">.6"))]
    assert spark.range(1).select(labels.last_match(rules), labels.first_match(rules)).first()[:] == (">.6", ">0")


@pytest.mark.parametrize("text,want", [
    ("Total!!Male!!18 and 19 years", {"sex": 1, "minageyrs": 18, "maxageyrs": 19}),
    ("Total!!Female!!Under 5 years", {"sex": 2, "minageyrs": 0, "maxageyrs": 4}),
    ("Total!!85 years and over", {"minageyrs": 85, "maxageyrs": 110}),
    ("Total!!$10,000 to $14,999", {"mindollars": 10000, "maxdollars": 14999}),
    ("Total!!$200,000 or more", {"mindollars": 200000, "maxdollars": 250000}),
    ("Total!!Owner occupied!!Householder under 25 years", {"ownershp": 1, "minageyrs": 15, "maxageyrs": 24}),
    ("Total!!Family households!!Husband-wife family", {"family": 1, "sex": -999, "numprec": -999}),
])
def test_label_parts(spark, text, want):
    parsed = label_text.parse(F.lit(text))
    got = spark.range(1).select(*[parsed[k].alias(k) for k in want]).first().asDict()
    assert got == want


def test_two_way_table(spark):
    df = spark.createDataFrame([("r1", "c1", 2), ("r1", "c2", 3), ("r2", "c1", 5), (None, "c1", 9)], "r string, c string, n int")
    assert rows(tabulate.two_way(df, "r", "c", ["c1", "c2"], F.sum("n"))) == [("Total", 7, 3, 10), ("r1", 2, 3, 5), ("r2", 5, None, 5)]


def test_random_int_bounds(spark):
    df = spark.range(2000).select(random_int(F.lit(3), F.lit(7), "id", 1).alias("v"), random_int(F.lit(4), F.lit(4), "id", 1).alias("w"))
    assert df.agg(F.min("v"), F.max("v"), F.min("w"), F.max("w")).first()[:] == (3, 6, 4, 4)


def test_exact_quantiles_against_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.pow(F.col("id") % 977, 2) / 7).alias("v"))
    got = rows(exact_quantiles(df, ["g"], "v", {"p1": 0.1, "p5": 0.5, "p9": 0.9}), "g", "p1", "p5", "p9")
    want = rows(df.groupBy("g").agg(*[F.percentile("v", F.lit(p)) for p in (0.1, 0.5, 0.9)]))
    for a, b in zip(got, want):
        assert a == pytest.approx(b)


def test_group_stats_keep_null_groups(spark, paths):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, None)], "g string, v int")
    out = with_group_stats(df, ["g"], total=F.sum("v"), n=F.count(F.lit(1)))
    assert rows(out, "g", "total", "n") == [("a", 3, 2), ("a", 3, 2), (None, 5, 2), (None, 5, 2)]


def test_require_unique_fails_on_duplicates(spark):
    good = spark.range(3)
    assert joins.require_unique(good, ["id"]).count() == 3
    with pytest.raises(Exception, match="duplicate key"):
        joins.require_unique(good.unionByName(good), ["id"]).collect()
