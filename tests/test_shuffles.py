"""What is stored and shuffled: lines meet by order, candidates are made once, ranks shuffle no digests."""

from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from popweave.catalog import q_jobs, q_links, standins
from popweave.operators import random_merge
from popweave.operators.random_merge import Round, Side
from popweave.plans import jobs

KEYS = ["w_geocode", "h_geocode", "jobtype"]


@pytest.fixture
def no_broadcast(spark):
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    # Line 4 of order 0 comes twice, with another price.
    lines = spark.createDataFrame(
        [(o, o % 7, o % 5, k, float(k * 9), 10.0 + k, 0.0, 0.0, "ANR"[k % 3], "OF"[k % 2]) for o in range(200) for k in range(1, 5)] + [(0, 0, 0, 4, 36.0, 1.0, 0.0, 0.0, "N", "F")],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    lines = lines.withColumn("l_shipdate", F.expr("make_timestamp(1996 + l_orderkey % 6, 1, 1, 0, 0, 0)"))
    orders = spark.range(200).select(F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey"))
    customer = spark.range(20).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey"))
    return SimpleNamespace(spark=spark, lineitem=lines, orders=orders, customer=customer)


def test_lines_meet_where_the_join_with_orders_wants_them(spark, no_broadcast):
    t = _tables(spark)
    numbered = standins.lines(t)
    assert _plan(numbered.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))).count("Exchange hashpartitioning") == 2
    supplier = spark.range(5).withColumnRenamed("id", "s_suppkey")
    by_supplier = standins.lines(t, ids_only=True, meet="l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    assert _plan(by_supplier).count("Exchange hashpartitioning") == 2
    twice = {r["line_key"]: r["l_extendedprice"] for r in numbered.where("l_orderkey = 0 and l_linenumber = 4").collect()}
    assert twice == {"0|4|0|0": 1.0, "0|4|0|0|2": 14.0} and numbered.select("line_key").distinct().count() == 801


def test_lines_of_an_order_with_most_of_them_are_numbered_alike(spark):
    t = _tables(spark)
    want = rows(standins.lines(t), "line_key", "l_extendedprice")
    t.lineitem = t.lineitem.withColumn("l_partkey", F.col("l_orderkey") * 10 + F.col("l_partkey")).withColumn("l_orderkey", F.lit(None).cast("long"))
    hot = standins.lines(t)
    assert hot.count() == len(want) and hot.select("line_key").distinct().count() == len(want)


def _pairs(spark):
    codes = ["111", "222", "112", "331"]
    cand = spark.createDataFrame([(i, i % 13, i % 2, "JT", "jidodJT" + codes[i % 4 if i % 3 else 0]) for i in range(120)] + [(900, None, 0, "JT", "jidodJT111")],
                                 "pk int, w_geocode int, h_geocode int, jobtype string, jobidod string").withColumn("jobidod_counter", F.lit(1))
    counts = "w_geocode int, h_geocode int, jobtype string, S000 int, SA01 int, SA02 int, SA03 int, SE01 int, SE02 int, SE03 int, SI01 int, SI02 int, SI03 int"
    expected = spark.createDataFrame([(w, h, "JT", 1 + (w + h) % 3, 1, 1, 0, 1, 1, 0, 1, w % 2, 0) for w in range(12) for h in range(2)] + [(None, 0, "JT", 2, 1, 1, 0, 1, 1, 0, 1, 1, 0)], counts)
    return jobs.drop_impossible_pairs(cand, expected, KEYS, q_jobs.STEMS)


def test_pairs_meet_once_where_no_key_is_hot(spark, monkeypatch):
    spark.conf.set("popweave.spread", "400")  # every key is hot
    dealt = rows(_pairs(spark))
    spark.conf.unset("popweave.spread")
    monkeypatch.setattr(jobs, "spread_join", lambda *_: pytest.fail("keys that are not hot were dealt out"))
    met = rows(_pairs(spark))
    assert met == dealt and {r[-1] for r in met} >= {"S000=1", "S000>2"} and any(r[-1].startswith("jidod") for r in met)


def test_candidates_are_made_once_for_all_sides(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(jobs, "three_way_match", lambda *a: sides.extend(a[:3]))
    q_jobs._three_way(_tables(spark))
    assert len(sides) == 3 and all(any("candidates" in f for f in side.inputFiles()) for side in sides)


def test_ranks_shuffle_no_digests(spark):
    p = spark.range(500).select(F.col("id").alias("p"), (F.col("id") % 3).alias("b"))
    s = spark.range(400).select(F.col("id").alias("s"), (F.col("id") % 2).alias("sb"), (F.col("id") % 4).alias("first"))
    spark.conf.set("popweave.spread", "40")
    cascade = random_merge._Cascade(Side(p, "p"), Side(s, "s", [("first", False)]), [Round("b", [("b", "b", "sb")])])
    plan = _plan(cascade.rank(cascade.all, 0, 5))
    spark.conf.unset("popweave.spread")
    assert "_order" in plan and "_order" not in plan.split("REPARTITION_BY_NUM", 1)[1]


def test_outside_jobs_are_stored_without_their_traits(spark, monkeypatch):
    left = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("c", 2, 7)], "jobid string, j_block int, j_age int")
    stored = []
    monkeypatch.setattr(q_links, "_jobs_linked", lambda t: (None, SimpleNamespace(secondary_left=left)))
    monkeypatch.setattr(q_links, "cut", lambda df, *_: stored.append(df.columns) or df)
    out = rows(q_links.pl_16_outside(None), "jobid", "precid")
    assert stored == [["jobid", "j_block"]] and [r[0] for r in out] == ["a", "b", "c"] and {r[1] for r in out} == {"1PJ1", "1PJ2", "2PJ1"}
