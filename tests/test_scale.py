"""Work that must not grow with keys that are spread evenly, and results that can be written."""

from pyspark.sql import functions as F

from conftest import SF, rows
from popweave.catalog import QUERIES
from popweave.operators import hot, spatial
from popweave.operators.ranks import random_rank


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_that_differ_by_case_can_be_written(spark, tmp_path):
    made = QUERIES["ag_09"](spark, SF)
    made.write.parquet(str(tmp_path / "out"))
    assert made.columns == ["o_orderpriority", "F", "f_percent", "f"]
    assert made.select("f", "F").count() == made.count() > 0
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_evenly_spread_keys_join_plainly(spark):
    big = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    joined = hot.spread_join(big, small, ["k"])
    assert hot.listed_hot_groups(big, ["k"]) is None and "_piece" not in plan(joined)
    assert joined.count() == 1000


def test_hot_groups_of_a_class_are_told_apart(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 900, F.lit(-1)).when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id")).alias("k"))
    found = {r["k"]: r["_pieces"] for r in hot.listed_hot_groups(df, ["k"]).collect()}
    n = hot.spread(spark)
    assert found == {-1: -(-900 * n // 3000), None: -(-600 * n // 3000)}


def test_digests_are_not_shuffled(spark):
    df = spark.range(2000).select("id", (F.col("id") % 500).alias("g"))
    text = plan(random_rank(df, ["g"], "id", 7))
    assert "md5" in text.split("RepartitionByExpression")[0] and "md5" not in text.split("RepartitionByExpression")[1]


def test_search_of_neighbours_follows_rows(spark, monkeypatch):
    a = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    b = spark.range(9).select(F.col("id").alias("b"), (F.col("id") % 3).cast("double").alias("bx"), F.lit(1.0).alias("by"))
    once = rows(spatial.nearest(a, "id", b, "b", 2))
    monkeypatch.setattr(spatial, "AT_ONCE", 5)
    found = spatial.nearest(a, "id", b, "b", 2)
    assert "RepartitionByExpression [id" in plan(found) and ", 10" in plan(found) and rows(found) == once
