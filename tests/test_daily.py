"""Daily aggregation, the calendar spine and the modelling table against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import daily
from tidemark.operators.daily import (
    daily_max,
    daily_outcome,
    daily_panel,
    day_limits,
    fill_days,
    lead_forecast,
    modelling_table,
    study_period,
    unfolded_panel,
    with_calendar,
)

D = dt.date(2020, 2, 27)


def stamp(day, hour=0):
    return dt.datetime(day.year, day.month, day.day, hour)


def test_study_period_keeps_its_first_and_last_day(spark):
    days = [dt.datetime(2010, 12, 31, 23), dt.datetime(2011, 1, 1), dt.datetime(2022, 12, 31, 23), dt.datetime(2023, 1, 1)]
    for kind in ("timestamp", "timestamp_ntz", "date"):
        df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz").select(F.col("ts").cast(kind))
        assert study_period(df, "ts", 2011, 2022).count() == 2


def test_study_period_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(dt.datetime(2015, 1, 1),)], "ts timestamp_ntz").write.parquet(path)
    df = study_period(spark.read.parquet(path), "ts", 2011, 2022)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_daily_max_takes_the_maximum_of_the_derived_values(spark):
    rows = [("a", stamp(D, 1), 1.0, 9.0), ("a", stamp(D, 5), 4.0, 2.0), ("b", stamp(D), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, h double, p double")
    out = daily_max(df, "s", "ts", {"hstp": F.col("h") * F.col("p")}).orderBy("site").collect()
    assert [tuple(r) for r in out] == [("a", D, 9.0), ("b", D, 1.0)]


def test_daily_outcome_matches_brute_force(spark):
    rnd = random.Random(3)
    days = [D + dt.timedelta(i) for i in range(12)]
    sites = [f"s{i}" for i in range(6)]
    events = [(rnd.choice(sites[1:] + ["elsewhere"]), stamp(rnd.choice(days), rnd.randrange(24))) for _ in range(40)]
    events += [("s1", stamp(days[0] - dt.timedelta(1))), ("s1", stamp(days[-1] + dt.timedelta(1))), ("elsewhere", stamp(days[0]))]
    got = daily_outcome(
        spark.createDataFrame([(s,) for s in [*sites, None] for _ in range(3)], "site string"),
        spark.createDataFrame(events, "site string, ts timestamp_ntz"),
        "ts",
        days[0],
        days[-1],
    ).collect()
    hit = {(s, t.date()) for s, t in events}
    want = {(s, d, int((s, d) in hit)) for s in sites for d in days}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_daily_outcome_without_events_is_all_zero(spark):
    none = spark.createDataFrame([], "site string, ts timestamp_ntz")
    got = daily_outcome(spark.createDataFrame([("a",)], "site string"), none, "ts", D, D + dt.timedelta(2)).collect()
    assert sorted(tuple(r) for r in got) == [("a", D + dt.timedelta(i), 0) for i in range(3)]


def test_fill_days_keeps_values_and_fills_gaps(spark):
    rows = [("a", D, 1, 5.0), ("a", D + dt.timedelta(2), 0, None), ("b", D + dt.timedelta(1), 1, 7.0), ("b", D - dt.timedelta(9), 1, 1.0)]
    df = spark.createDataFrame(rows, "site string, day date, y int, v double")
    out = fill_days(df, D, D + dt.timedelta(2), zero=["y"]).orderBy("site", "day").collect()
    assert [(r.site, (r.day - D).days, r.y, r.v) for r in out] == [
        ("a", 0, 1, 5.0),
        ("a", 1, 0, None),
        ("a", 2, 0, None),
        ("b", 0, 0, None),
        ("b", 1, 1, 7.0),
        ("b", 2, 0, None),
    ]


def test_day_limits(spark):
    df = spark.createDataFrame([(stamp(D, 4),), (stamp(D + dt.timedelta(3), 1),)], "ts timestamp_ntz")
    lo, hi = day_limits(df, "ts")
    assert tuple(spark.range(1).select(lo, hi).first()) == (D, D + dt.timedelta(3))


def test_daily_panel_equals_the_joins(spark):
    rnd = random.Random(9)
    day = lambda: D + dt.timedelta(rnd.randrange(-2, 8))
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site string")
    events = spark.createDataFrame([(rnd.choice("abx"), stamp(day(), 3)) for _ in range(12)], "site string, ts timestamp_ntz")
    waves = spark.createDataFrame([(rnd.choice("acx"), day(), rnd.random()) for _ in range(30)], "site string, day date, h double")
    air = spark.createDataFrame([(rnd.choice("ab"), day(), rnd.randrange(40)) for _ in range(30)], "site string, day date, t int")
    period = (D, D + dt.timedelta(5))
    got = with_calendar(daily_panel(sites, events, "ts", *period, [waves, air]))
    daily = [f.groupBy("site", "day").agg(F.max(v).alias(v)) for f, v in ((waves, "h"), (air, "t"))]
    want = modelling_table(daily_outcome(sites, events, "ts", *period), *daily)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 18


def test_lead_forecast_and_modelling_table(spark):
    days = spark.createDataFrame([("a", D + dt.timedelta(3), 1), ("a", D + dt.timedelta(4), 0)], "site string, day date, y int")
    issues = [("a", D, 20.0), ("a", D, 22.0), ("a", D + dt.timedelta(2), 30.0)]
    forecasts = spark.createDataFrame(issues, "site string, issue_day date, t_air double")
    out = lead_forecast(days, forecasts, "t_air", 3).orderBy("day").collect()
    assert [r.t_air for r in out] == [22.0, None]
    hazards = spark.createDataFrame([("a", D + dt.timedelta(4), 0.5)], "site string, day date, cos4 double")
    rows = modelling_table(lead_forecast(days, forecasts, "t_air", 3), hazards).orderBy("day").collect()
    assert [(r.y, r.t_air, r.cos4, r.mday, r.month, r.wday) for r in rows] == [(1, 22.0, None, 1, 3, 7), (0, None, 0.5, 2, 3, 1)]


def test_one_scan_equals_separate_sources(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *(stamp(D + dt.timedelta(rnd.randrange(9)), rnd.randrange(24)) for _ in range(5))]), rnd.choice(["hit", "seen", None]), rnd.choice([None, rnd.random()])) for _ in range(60)]
    rows += [("undated", None, "hit", 1.0), ("late", stamp(D + dt.timedelta(9)), "seen", 7.0)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "s string, ts timestamp_ntz, kind string, v double").write.parquet(path)
    df = spark.read.parquet(path)
    hit, seen = F.col("kind") == "hit", F.when(F.col("kind") == "seen", F.col("v"))

    written = []
    plain = daily.materialise
    monkeypatch.setattr(daily, "materialise", lambda d, name: written.append(d) or plain(d, name))
    got = unfolded_panel(df, "s", "ts", hit, {"h": seen}, {"t": F.col("v")}, 3)
    found = got.collect()
    assert len(written) == 1 and not set(got.inputFiles()) & set(df.inputFiles())  # the table is read by one job

    marks = df.where(hit).select(F.col("s").alias("site"), "ts")
    day = F.to_date("ts")
    waves = df.select(F.col("s").alias("site"), day.alias("day"), seen.alias("h"))
    due = df.select(F.col("s").alias("site"), F.date_add(day, 3).alias("day"), F.col("v").alias("t"))
    want = daily_panel(df.select(F.col("s").alias("site")), marks, "ts", *day_limits(df, "ts"), [waves, due])
    assert got.columns == want.columns
    assert sorted(map(str, found)) == sorted(map(str, want.collect())) and len(found) == 50
    assert unfolded_panel(df.limit(0), "s", "ts", hit, {"h": seen}).count() == 0
    outcome = unfolded_panel(df, "s", "ts", hit)
    assert sorted(map(str, outcome.collect())) == sorted(map(str, want.select("site", "day", "y").collect()))
