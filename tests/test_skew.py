import random

from conftest import rows_of
from pyspark.sql import functions as F

from starcast.operators import skew
from starcast.operators.skew import blocked_join, heavy_in_each, heavy_in_pairs, heavy_keys, lookup_join, repeat_rows


def skewed(spark, n, name, seed):
    """A third of the rows on key 0, some of them identical, and a few NULL keys."""
    rng = random.Random(seed)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 12), rng.randrange(5)) for _ in range(n)]
    return spark.createDataFrame([*rows, (None, 1)], f"k long, {name} long").repartition(4)


def test_heavy_keys_lists_only_heavy_ones(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(2,)] * 3 + [(3,)] * 4, "k long")
    assert rows_of(heavy_keys(df, ["k"], 3).table) == [(1, 10), (3, 4)]
    assert heavy_keys(df, ["k"], 10).table is None
    assert heavy_keys(df, ["k"], 20, total=17).table is None
    a, b = heavy_in_each(df.withColumn("j", F.col("k") + 1), ["k", "j"], 5, 17)
    assert rows_of(a.table) == [(1, 10)] and rows_of(b.table) == [(2, 10)]


def test_heavy_lists_add_up(spark):
    left = heavy_keys(spark.createDataFrame([(1,)] * 5 + [(2,)] * 4, "k long"), ["k"], 2)
    right = heavy_keys(spark.createDataFrame([(1,)] * 3, "k long"), ["k"], 2)
    none = heavy_keys(spark.createDataFrame([(1,)], "k long"), ["k"], 2)
    assert rows_of(left.plus(right).table) == [(1, 8), (2, 4)]
    assert rows_of(left.plus(none).table) == [(1, 5), (2, 4)]
    assert none.plus(none).table is None


def test_lookup_join_equals_plain_join(spark):
    fact = skewed(spark, 200, "a", 1)
    dim = spark.createDataFrame([(k, k * 10) for k in range(8)], "k long, b long")
    for how in ("inner", "left"):
        cut = lookup_join(fact, dim, ["k"], how, heavy_keys(fact, ["k"], 10))
        assert rows_of(cut, "k", "a", "b") == rows_of(fact.join(dim, "k", how), "k", "a", "b")


def test_lookup_join_with_a_bound_per_key_column(spark):
    fact = skewed(spark, 200, "j", 2).withColumn("a", F.col("j") * 2)
    dim = spark.createDataFrame([(k, j, k * 10 + j) for k in range(8) for j in range(5)], "k long, j long, b long")
    lists = [heavy_keys(fact, ["k"], 10), heavy_keys(fact, ["j"], 10)]
    cut = lookup_join(fact, dim, ["k", "j"], "left", lists)
    assert rows_of(cut, "k", "j", "a", "b") == rows_of(fact.join(dim, ["k", "j"], "left"), "k", "j", "a", "b")


def test_blocked_join_equals_plain_join(spark):
    left, right = skewed(spark, 120, "a", 3), skewed(spark, 90, "b", 4)
    expected = rows_of(left.join(right, "k"), "k", "a", "b")
    cut = blocked_join(left, right, ["k"], heavy_keys(left, ["k"], 7), heavy_keys(right, ["k"], 5))
    assert rows_of(cut, "k", "a", "b") == expected
    one_side = blocked_join(left, right, ["k"], heavy_keys(left, ["k"], 7), heavy_keys(right, ["k"], 5_000))
    assert rows_of(one_side, "k", "a", "b") == expected


def test_identical_rows_of_a_heavy_key_are_spread(spark):
    # 400 copies of one row, read by 4 tasks: the tasks deal them to different blocks.
    fact = spark.createDataFrame([(1, 1)] * 400, "k long, a long").repartition(4)
    dim = spark.createDataFrame([(1, 5)], "k long, b long")
    joined = lookup_join(fact, dim, ["k"], heavy=heavy_keys(fact, ["k"], 100))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in plan and "spark_partition_id" in plan.lower()
    assert joined.count() == 400
    from starcast.operators.skew import _deal

    dealt = fact.withColumn("n", F.lit(4)).select(_deal(fact, "n").alias("block"))
    assert dealt.distinct().count() > 1


def test_repeat_rows(spark):
    df = spark.createDataFrame([("x", 1), ("y", 7), ("z", 3)], "v string, copies long")
    expected = ["x"] + ["y"] * 7 + ["z"] * 3
    for block in (2, 3, 100):
        assert [v for (v,) in rows_of(repeat_rows(df, "copies", 7, block))] == expected
    single = repeat_rows(df.where("v = 'x'"), "copies", 1)
    assert rows_of(single) == [("x",)]


def test_rows_without_a_key_are_spread_too(spark):
    fact = spark.createDataFrame([(None, i) for i in range(60)] + [(1, 99)], "k long, a long").repartition(4)
    dim = spark.createDataFrame([(1, 5), (None, 6)], "k long, b long")
    heavy = heavy_keys(fact, ["k"], 10)
    joined = lookup_join(fact, dim, ["k"], "left", heavy)
    assert rows_of(joined, "k", "a", "b") == rows_of(fact.join(dim, "k", "left"), "k", "a", "b")
    from starcast.operators.skew import _deal

    dealt = heavy.attach(fact, "blocks").where("k is null")
    assert dealt.select("blocks").distinct().first()[0] == 6
    assert dealt.select(_deal(fact, "blocks")).distinct().count() > 1


def test_any_number_of_heavy_keys_is_listed(spark):
    df = spark.range(400_000).select((F.col("id") % 150_000).alias("k"))
    heavy = heavy_keys(df, ["k"], 2)
    assert heavy.table.count() == 100_000
    left, right = df.where("k % 1000 = 0"), df.where("k % 2000 = 0").withColumn("b", F.lit(1))
    lists = heavy_keys(left, ["k"], 1), heavy_keys(right, ["k"], 1)
    assert blocked_join(left, right, ["k"], *lists).count() == left.join(right, "k").count()


def test_heavy_keys_of_pairs_and_of_their_columns(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_LOOKUP_BLOCK", 3)
    df = spark.createDataFrame([(1, 1)] * 4 + [(1, 2)] * 2 + [(2, 2)] * 3, "u long, b long")
    users, businesses, pairs = heavy_in_pairs(df, ["u", "b"], 9)
    assert rows_of(users.table) == [(1, 6)] and rows_of(businesses.table) == [(1, 4), (2, 5)]
    assert rows_of(pairs.table) == [(1, 1, 4)]
    assert [heavy.table for heavy in heavy_in_pairs(df, ["u", "b"], 3)] == [None] * 3


def test_joins_without_a_list_start_no_job(spark):
    fact, dim = skewed(spark, 50, "a", 5), spark.createDataFrame([(1, 5)], "k long, b long")
    spark.sparkContext.setJobGroup("counted", "jobs of the joins")
    joined = [lookup_join(fact, dim, ["k"]), blocked_join(fact, fact.withColumnRenamed("a", "b"), ["k"])]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0 and all(df.count() for df in joined)
