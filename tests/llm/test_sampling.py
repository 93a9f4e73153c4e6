from popweave.llm.sampling import hashed_sample


def test_sample_is_bounded_and_the_same_for_any_partitions(spark):
    df = spark.range(20000).withColumnRenamed("id", "i")
    one, many = (sorted(r["i"] for r in hashed_sample(df.repartition(n), ["i"], 700).collect()) for n in (1, 9))
    assert one == many and len(one) == 700
    assert hashed_sample(df.limit(10), ["i"], 700).count() == 10
    assert hashed_sample(df.limit(0), ["i"], 700).count() == 0
