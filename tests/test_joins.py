"""The hot-key join gives what a plain join gives."""

import random

import pytest

from tidemark.operators.joins import broadcast_levels, hot_key_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, how):
    rnd = random.Random(2)
    left = [(i, "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", "gone", None])) for i in range(600)]
    right = [("hot", 1), ("a", 2), ("a", 3), ("b", 4), ("unused", 5)]
    a = spark.createDataFrame(left, "id int, k string")
    b = spark.createDataFrame(right, "k string, v int")
    got = hot_key_join(a, b, ["k"], how, ["id"], rows_per_task=40, share=0.2)
    want = a.join(b, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_every_key_hot(spark, how):
    a = spark.range(200).selectExpr("id", "id % 4 AS k")
    b = spark.createDataFrame([(0, "x"), (0, "y"), (2, "z")], "k long, v string")
    got = hot_key_join(a, b, ["k"], how, ["id"], rows_per_task=3, share=0.0)
    assert sorted(map(str, got.collect())) == sorted(map(str, a.join(b, ["k"], how).collect()))


def test_hot_keys_are_spread(spark):
    a = spark.range(1000).selectExpr("id", "'hot' AS k")
    b = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = hot_key_join(a, b, ["k"], "inner", ["id"], rows_per_task=60).rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 1000 and max(sizes) < 600


def test_other_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        hot_key_join(spark.range(1), spark.range(1), ["id"], "full", ["id"])


def test_broadcast_of_levels_is_checked(spark):
    few = spark.range(5)
    assert spark.range(9).join(broadcast_levels(few, few, most=5), "id").count() == 5
    beyond = spark.range(9).join(broadcast_levels(few, few, most=4), "id")
    assert beyond.count() == 5
