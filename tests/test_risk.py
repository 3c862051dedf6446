"""Column functions against hand-checked points."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_int, hash_unit
from tidemark.functions.risk import calendar, logistic, majority, risk_class, rule_risk, wave_factor, wave_incidence


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("direction, want", [(278.0, 1.0), (98.0, 1.0), (188.0, 0.0), (233.0, 0.25)])
def test_wave_incidence(spark, direction, want):
    assert one(spark, wave_incidence(F.lit(direction))) == pytest.approx(want, abs=1e-12)


def test_wave_factor(spark):
    assert one(spark, wave_factor(F.lit(1.5), F.lit(12.0))) == 18.0


def test_calendar_starts_the_week_on_monday(spark):
    days = [(dt.date(2023, 7, 3),), (dt.date(2023, 7, 9),)]
    df = spark.createDataFrame(days, "day date")
    rows = df.select(*[c.alias(n) for n, c in calendar(F.col("day")).items()]).collect()
    assert [tuple(r) for r in rows] == [(3, 7, 1), (9, 7, 7)]


@pytest.mark.parametrize(
    "month, t_air, wave, want",
    [
        (7, 25.0, 0.1, "noyade"),
        (7, 15.0, 0.9, "noyade"),
        (7, 15.0, 0.1, "pas_de_noyade"),
        (5, 25.0, 0.1, "noyade"),
        (5, 15.0, 0.9, "noyade"),
        (5, 15.0, 0.1, "pas_de_noyade"),
        (8, 25.0, 0.9, "noyade"),
        (8, 20.0, 0.5, "pas_de_noyade"),
        (8, None, 0.5, None),
        (None, 25.0, 0.5, None),
        (8, 25.0, None, None),
    ],
)
def test_rule_tree(spark, month, t_air, wave, want):
    df = spark.createDataFrame([(month, t_air, wave)], "month int, t_air double, wave double")
    assert df.select(rule_risk(F.col("month"), F.col("t_air"), F.col("wave")).alias("r")).first()["r"] == want


def test_rule_tree_uses_the_cuts_of_the_season(spark):
    df = spark.createDataFrame([(7, 18.0), (5, 18.0)], "month int, t_air double")
    risk = rule_risk(F.col("month"), F.col("t_air"), F.lit(0.0), summer=(15.0, 1.0), other=(20.0, 1.0))
    assert [r[0] for r in df.select(risk).collect()] == ["noyade", "pas_de_noyade"]


def test_risk_class_is_closed_on_the_left_and_keeps_one_in_the_last(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.3999,), (0.4,), (0.8,), (1.0,), (None,)], "p double")
    assert [r[0] for r in df.select(risk_class(F.col("p"))).collect()] == [1, 2, 2, 3, 5, 5, None]
    assert [r[0] for r in df.select(risk_class(F.col("p"), [0.5])).collect()] == [1, 1, 1, 1, 2, 2, None]


def test_logistic_and_majority(spark):
    df = spark.createDataFrame([(2.0, -1.0)], "a double, b double")
    p = df.select(logistic(0.5, {"a": 1.0, "b": 2.0}).alias("p")).first()["p"]
    assert p == pytest.approx(1 / (1 + 2.718281828459045 ** -0.5))
    votes = spark.createDataFrame([(0, 1, 1), (0, 0, 1)], "a int, b int, c int")
    assert [r[0] for r in votes.select(majority([F.col(c) for c in "abc"])).collect()] == [1, 0]


def test_hashes_follow_md5(spark):
    import hashlib

    want = int(hashlib.md5(b"7|42").hexdigest()[:8], 16)
    assert one(spark, hash_int(F.lit(7), 42)) == want
    assert one(spark, hash_unit(F.lit(7), 42)) == want / 2**32
