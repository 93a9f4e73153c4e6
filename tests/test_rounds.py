"""What a round of a cascade or a selection costs, and that the cheap and the cut-up way give the same rows."""

import os

from conftest import rows
from pyspark.sql import functions as F

from popweave.operators import hot, random_merge, select
from popweave.operators.random_merge import Round, Side, merge_cascade
from popweave.plans import jobs


def _candidates(spark):
    return spark.range(600).select(
        F.col("id").alias("pk"), (F.col("id") % 20).alias("b"), (F.col("id") % 100).alias("ch"), (F.col("id") * 7 % 3).alias("t"), F.lit(7).alias("want"))


def _fit(spark):
    cand = _candidates(spark)
    target = cand.groupBy("b", F.lit("t").alias("trait"), F.col("t").cast("string").alias("code")).agg(F.lit(2).alias("n"))
    return rows(jobs.select_by_fit(cand, target, ["b"], ["b", "ch"], ["b"], "pk", "want", F.lit(False), ["t"], 3), "pk", "seed", "fitness")


def test_selection_stores_nothing_where_no_pair_is_hot(spark, monkeypatch):
    spark.conf.set("popweave.spread", "40")  # every pair is hot
    cut_up = _fit(spark)
    spark.conf.unset("popweave.spread")

    def stored(*_):
        raise AssertionError("rows of all seeds were stored")

    monkeypatch.setattr(select, "cut", stored)
    assert _fit(spark) == cut_up


def _agreement(spark):
    cand = _candidates(spark).withColumn("prob_selected", F.lit(0.0))
    margin = lambda n: cand.groupBy("b", F.lit("t").alias("trait"), F.col("t").cast("string").alias("code")).agg(F.lit(n).alias("n"))
    got = jobs.select_jobs_by_agreement(cand, {"x": margin(2), "y": margin(3)}, ["b"], ["b", "ch"], ["b"], "pk", "want", ["t"], 2)
    return rows(got, "pk", "seed", "fitness")


def test_agreement_joins_plainly_where_no_block_is_hot(spark, monkeypatch):
    spark.conf.set("popweave.spread", "40")
    cut_up = _agreement(spark)
    spark.conf.unset("popweave.spread")

    def dealt(*_):
        raise AssertionError("keys were counted for a join without hot keys")

    monkeypatch.setattr(jobs, "spread_join", dealt)
    assert _agreement(spark) == cut_up


def _sides(spark):
    p = spark.range(500).select(F.col("id").alias("p"), F.when(F.col("id") % 9 > 0, F.col("id") % 60).alias("b"), (F.col("id") % 2).alias("c"), F.lit("x").alias("d"))
    s = spark.range(400).select(F.col("id").alias("s"), (F.col("id") % 50).alias("sb"), (F.col("id") % 3).alias("sc"), F.lit("y").alias("sd"), (F.col("id") % 4).alias("first"))
    rounds = [Round("bc", [("b", "b", "sb"), ("c", "c", "sc")]), Round("none", [("d", "d", "sd")]), Round("b", [("b", "b", "sb")]), Round("c", [("c", "c", "sc")])]
    return Side(p, "p"), Side(s, "s", [("first", False)]), rounds


def test_rounds_rank_where_groups_meet(spark, monkeypatch):
    def ranked(*_):
        raise AssertionError("groups of small tables were cut up")

    spark.conf.set("popweave.spread", "400")  # most groups are hot
    cut_up = merge_cascade(*_sides(spark), 5)
    want = rows(cut_up.pairs), rows(cut_up.primary_left, "p"), rows(cut_up.secondary_left, "s")
    spark.conf.unset("popweave.spread")
    monkeypatch.setattr(random_merge._Cascade, "rank", ranked)
    met = merge_cascade(*_sides(spark), 5)
    assert (rows(met.pairs), rows(met.primary_left, "p"), rows(met.secondary_left, "s")) == want
    assert len(want[0]) > 300


def test_a_round_without_partners_writes_nothing(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(random_merge, "scratch_path", lambda *a: paths.append(hot_path(*a)) or paths[-1])
    want = rows(merge_cascade(*_sides(spark), 5).pairs)
    monkeypatch.setattr(hot, "AT_ONCE", 0)
    assert rows(merge_cascade(*_sides(spark), 5).pairs) == want
    assert [f for f in ("match_round=1", "match_round=2", "match_round=3") if os.path.exists(f"{paths[-1]}/{f}")] == ["match_round=1", "match_round=3"]


hot_path = random_merge.scratch_path


def test_keys_that_come_together_do_not_run_into_each_other(spark):
    p = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "a", None)], "p int, x string, y string")
    s = spark.createDataFrame([(7, "ab", "c"), (8, "a:", "bc"), (9, "a", None)], "s int, u string, v string")
    got = merge_cascade(Side(p, "p"), Side(s, "s"), [Round("xy", [("x", "x", "u"), ("y", "y", "v")])], 1)
    assert rows(got.pairs) == [(2, 7, 1)] and rows(got.primary_left, "p") == [(1,), (3,)]


def test_repair_makes_ranks_once_and_joins_rows_once(spark, monkeypatch):
    joins, labels = [], []
    join, store = jobs.attach, jobs.cut
    monkeypatch.setattr(jobs, "attach", lambda *a: joins.append(1) or join(*a))
    monkeypatch.setattr(jobs, "cut", lambda df, label="cut": labels.append(label) or store(df, label))
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1), (4, None, 1), (5, None, None)], "pk int, b string, t int")
    expected = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 1, 2)], "b string, code int, n long")
    out, report = jobs.repair_margins(df, "pk", "b", "t", expected, 3)
    assert sorted((r["b"] or "", r["t"]) for r in out.collect()) == [("", 1), ("", 1), ("a", 1), ("a", 2), ("a", 2)] and report.isEmpty()
    assert len(joins) == 1 and labels.count("turns") == 1


def _nested(spark):
    p = spark.range(900).select(F.col("id").alias("p"), F.when(F.col("id") % 11 > 0, F.col("id") % 70).alias("b"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("c"),
                                (F.col("id") % 5).alias("d"))
    s = spark.range(700).select(F.col("id").alias("s"), F.when(F.col("id") % 13 > 0, F.col("id") % 60).alias("sb"), (F.col("id") % 3).alias("sc"), (F.col("id") % 4).alias("sd"),
                                (F.col("id") % 3).alias("first"))
    b, c, d = ("b", "b", "sb"), ("c", "c", "sc"), ("d", "d", "sd")
    return Side(p, "p"), Side(s, "s", [("first", False)]), [Round("bcd", [b, c, d]), Round("bc", [b, c]), Round("b", [b]), Round("d", [d])]


def test_rounds_that_share_keys_are_one_shuffle(spark, monkeypatch):
    chain = random_merge.CHAIN
    monkeypatch.setattr(random_merge, "CHAIN", 1)
    cut_up = merge_cascade(*_nested(spark), 5)
    want = rows(cut_up.pairs), rows(cut_up.primary_left, "p"), rows(cut_up.secondary_left, "s"), cut_up.rounds
    monkeypatch.setattr(random_merge, "CHAIN", chain)
    alone, met = [], random_merge._Cascade.meet
    monkeypatch.setattr(random_merge._Cascade, "meet", lambda self, rows, number, seed: alone.append(number) or met(self, rows, number, seed))
    got = merge_cascade(*_nested(spark), 5)
    assert (rows(got.pairs), rows(got.primary_left, "p"), rows(got.secondary_left, "s"), got.rounds) == want
    assert alone == [3]


def test_shared_rounds_may_settle_all_rows_or_none(spark):
    p, s = spark.range(6).select(F.col("id").alias("p"), F.col("id").alias("b"), F.lit(1).alias("c")), spark.range(6).select(F.col("id").alias("s"), F.col("id").alias("sb"), F.lit(1).alias("sc"))
    b, c = ("b", "b", "sb"), ("c", "c", "sc")
    rounds = [Round("bc", [b, c]), Round("b", [b]), Round("c", [c])]
    full = merge_cascade(Side(p, "p"), Side(s, "s"), rounds, 5)
    assert rows(full.pairs) == [(i, i, 1) for i in range(6)] and full.primary_left.isEmpty() and full.secondary_left.isEmpty()
    none = merge_cascade(Side(p.where("false"), "p"), Side(s, "s"), rounds, 5)
    assert none.pairs.isEmpty() and none.secondary_left.count() == 6


def test_rows_that_take_no_part_in_a_round_are_not_moved(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(random_merge, "scratch_path", lambda *a: paths.append(hot_path(*a)) or paths[-1])
    some = lambda k, name: F.when(F.col("id") % 3 == k, F.col("id") % 8).alias(name)
    p = spark.range(300).select(F.col("id").alias("p"), *[some(k, f"k{k}") for k in range(3)])
    s = spark.range(150).select(F.col("id").alias("s"), *[some(k, f"s{k}") for k in range(3)])
    got = merge_cascade(Side(p, "p"), Side(s, "s"), [Round(f"k{k}", [(f"k{k}", f"k{k}", f"s{k}")]) for k in range(3)], 5)
    assert got.pairs.count() == 150 and got.primary_left.count() == 150 and got.secondary_left.isEmpty()
    assert [spark.read.parquet(f"{paths[-1]}/match_round={i}").where("_group is not null").count() for i in (1, 2, 3)] == [100] * 3
    # 50 of the 100 rows that have the key of the last round on the left side stay alone; nothing else is there
    assert spark.read.parquet(f"{paths[-1]}/match_round=3").count() == 150


def test_key_values_of_one_side_take_no_part(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(random_merge, "scratch_path", lambda *a: paths.append(hot_path(*a)) or paths[-1])
    p = spark.range(400).select(F.col("id").alias("p"), (F.col("id") % 40).alias("b"), (F.col("id") % 50).alias("c"))
    s = spark.range(90).select(F.col("id").alias("s"), (F.col("id") % 4 + 100).alias("sb"), (F.col("id") % 5).alias("sc"))
    s = s.unionByName(spark.range(90, 100).select(F.col("id").alias("s"), (F.col("id") % 2).alias("sb"), F.lit(None).cast("long").alias("sc")))
    got = merge_cascade(Side(p, "p"), Side(s, "s"), [Round("b", [("b", "b", "sb")]), Round("c", [("c", "c", "sc")])], 5)
    first = got.pairs.where("match_round = 1").select("p")
    open_with_value = p.where("c < 5").join(first, "p", "left_anti").count()
    assert first.count() == 10 and got.pairs.where("match_round = 2").count() == open_with_value
    # the other open rows of the left side, more than 300, are not in the second round
    assert spark.read.parquet(f"{paths[-1]}/match_round=2").where("_p is not null").count() == open_with_value


def test_an_agreement_pass_stores_rows_once(spark, monkeypatch):
    cand = spark.range(600).select(
        F.col("id").alias("pk"), F.when(F.col("id") % 31 > 0, F.col("id") % 20).alias("b"), F.when(F.col("id") % 13 > 0, F.col("id") % 100).alias("ch"),
        (F.col("id") * 7 % 3).alias("t"), F.when(F.col("id") % 11 > 0, F.col("id") % 2).alias("u"), F.when(F.col("id") % 20 != 4, F.when(F.col("id") % 20 < 9, 6).otherwise(4)).alias("want"),
        F.when(F.col("id") % 50 == 7, 1.0).otherwise(0.0).alias("prob_selected"))
    margin = lambda trait, n: cand.groupBy("b", F.lit(trait).alias("trait"), F.col(trait[0]).cast("string").alias("code")).agg(F.lit(n).alias("n"))
    other = cand.groupBy("b").agg(F.lit("x").alias("trait"), F.lit("1").alias("code"), F.lit(4).alias("n"))
    agree = lambda: rows(jobs.select_jobs_by_agreement(cand, {"t": margin("t", 2).unionByName(other), "u": margin("u", 3)}, ["b"], ["b", "ch"], ["b"], "pk", "want", ["t", "u"], 2),
                         "pk", "b", "ch", "want", "seed", "select_job", "fitness")
    spark.conf.set("popweave.spread", "40")  # every block is hot
    cut_up = agree()
    spark.conf.unset("popweave.spread")

    def stored(*_):
        raise AssertionError("a table was stored besides the state of a pass")

    monkeypatch.setattr(jobs, "cut", stored)
    assert agree() == cut_up and len(cut_up) > 80
    monkeypatch.setattr(jobs, "FEW_SUMS", 0)  # as where traits have many values
    assert agree() == cut_up
