"""Joins with hot keys and distributed numbering."""

import pytest
from pyspark.sql import functions as F

from gradewell.plans import skew


def hot_tables(spark):
    left = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("key")
    ).withColumn("key", F.when(F.col("id") % 500 == 1, F.lit(None)).otherwise(F.col("key")))
    right = spark.range(450).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") * 2).alias("v"))
    right = right.union(spark.createDataFrame([("hot", -1)], "key string, v long"))
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    left, right = hot_tables(spark)
    want = sorted(map(str, left.join(right, ["key"], how).collect()))
    hot = skew.hot_keys(left, ["key"], rows=1)
    assert hot
    for keys in (hot, None, []):
        joined = skew.salted_join(left, right, ["key"], how, spread=["id"], hot=keys)
        got = sorted(map(str, joined.select(*left.join(right, ["key"], how).columns).collect()))
        assert got == want


def test_hot_key_is_found_and_spread(spark):
    left, right = hot_tables(spark)
    wanted = left.filter("key = 'hot'").select(F.xxhash64("key")).first()[0]
    assert skew.hot_keys(left, ["key"], share=0.05, rows=1) == [wanted]
    assert skew.hot_keys(left, ["key"], share=0.05) == []
    joined = skew.salted_join(left, right, ["key"], spread=["id"], hot=[wanted], salts=16)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    assert joined.count() == left.count()


def test_a_join_that_would_lose_right_rows_is_refused(spark):
    left, right = hot_tables(spark)
    with pytest.raises(ValueError):
        skew.salted_join(left, right, ["key"], "full")


def test_number_rows(spark):
    rows = [(a, b) for a in (5, 1, 1, 1, 3) for b in range(0)] + [(1, i) for i in range(700, 0, -1)] + [(0, 5), (9, 1), (3, 3)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = [tuple(r) for r in skew.number_rows(df, ["a", "b"], "n", start=1, partitions=13).orderBy("n").collect()]
    assert got == [(*row, i + 1) for i, row in enumerate(sorted(rows))]
    assert skew.number_rows(df.filter("a > 100"), ["a", "b"]).count() == 0


def test_number_rows_has_no_one_task_window(spark):
    df = skew.number_rows(spark.range(1000).withColumnRenamed("id", "a"), ["a"])
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_group_total(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5)], "g string, n long")
    assert sorted(tuple(r) for r in skew.group_total(df, ["g"], "n").collect()) == [("x", 1, 3), ("x", 2, 3), ("y", 5, 5)]


def test_a_third_of_all_rows_under_one_key_goes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(300_000).selectExpr("id", "if(id % 3 = 0, -1, id) as key")
        right = spark.range(300_000).selectExpr("id as key", "id * 2 as v").union(spark.sql("select -1L, 7L"))

        def largest_share(joined):
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 300_000
            return max(sizes) / 300_000

        assert largest_share(left.join(right, ["key"], "left")) > 0.33
        joined = skew.lookup_join(left, right, ["key"], "left", spread=["id"])
        assert largest_share(joined) < 0.2
        assert joined.filter("key = -1 and v = 7").count() == 100_000
    finally:
        for key in settings:
            spark.conf.unset(key)
