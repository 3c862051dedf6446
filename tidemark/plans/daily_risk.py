"""Daily features, outcomes and the rule tree on observation and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.risk import POSITIVE, logistic, majority, rule_risk, wave_factor, wave_incidence
from tidemark.models.classifiers import majority_vote
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
from tidemark.operators.evaluate import confusion_cells, confusion_counts, count_metrics
from tidemark.plans.registry import query
from tidemark.plans.tables import line_values, table
from tidemark.session import shuffle_partitions

SITE_DAYS_SQL = """
site_days AS (
  SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS "day",
         max(pow(cos(radians(278.0 - l_quantity)), 4)) AS cos4,
         max(l_quantity * l_discount) AS hstp,
         max(l_extendedprice / 2500.0) AS t_air,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
  FROM lineitem GROUP BY 1, 2)"""

RULE_SQL = """CASE WHEN t_air IS NULL OR hstp IS NULL THEN NULL
            WHEN t_air > {t} THEN 'noyade' WHEN hstp > {w} THEN 'noyade' ELSE 'pas_de_noyade' END"""
SEASON_RULE_SQL = (
    "CASE WHEN month(\"day\") IN (7, 8) THEN " + RULE_SQL.format(t=20, w=0.5)
    + " ELSE " + RULE_SQL.format(t=20, w=0.5) + " END"
)

EVENT_SPINE_SQL = """
limits AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS "day" FROM limits),
incidents AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS "day" FROM events WHERE event_type = 'purchase'),
outcome AS (
  SELECT s.user_id AS site, d."day" AS "day", CASE WHEN i.user_id IS NULL THEN 0 ELSE 1 END AS y
  FROM (SELECT DISTINCT user_id FROM events) s CROSS JOIN days d
  LEFT JOIN incidents i ON i.user_id = s.user_id AND i."day" = d."day")"""


def _site_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily maxima and the outcome from one scan and one shuffle of partial maxima."""
    return daily_max(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", line_values())


@query("""
SELECT l_orderkey, l_linenumber, round(pow(cos(radians(278.0 - l_quantity)), 4), 9) AS cos4,
       round(l_quantity * l_discount, 9) AS hstp
FROM lineitem""")
def wave_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(wave_incidence(F.col("l_quantity")), 9).alias("cos4"),
        F.round(wave_factor(F.col("l_quantity"), F.col("l_discount")), 9).alias("hstp"),
    )


@query("""
SELECT o_orderkey, CAST(day(o_orderdate) AS INT) AS mday, CAST(month(o_orderdate) AS INT) AS "month",
       CAST(isodow(o_orderdate) AS INT) AS wday
FROM orders""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return with_calendar(orders).drop("day")


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "day" FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def orders_in_study_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = study_period(table(spark, sf_dir, "orders"), "o_orderdate", 1997, 1998)
    return kept.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("""
SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS "day",
       round(max(pow(cos(radians(278.0 - l_quantity)), 4)), 9) AS cos4, round(max(l_quantity * l_discount), 9) AS hstp
FROM lineitem GROUP BY 1, 2""")
def daily_wave_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {k: v for k, v in line_values().items() if k in ("cos4", "hstp")}
    daily = daily_max(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", values)
    return daily.withColumns({k: F.round(k, 9) for k in values})


@query("""
SELECT user_id AS site, CAST(ts AS DATE) AS "day", max("value") AS t_air FROM events GROUP BY 1, 2""")
def daily_temperature_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_max(table(spark, sf_dir, "events"), "user_id", "ts", {"t_air": F.col("value")})


def _event_sources(spark: SparkSession, sf_dir: str) -> tuple:
    """Sites, incidents and period of the events table: purchases are the incidents."""
    events = table(spark, sf_dir, "events")
    incidents = events.where("event_type = 'purchase'").select(F.col("user_id").alias("site"), "ts")
    return events.select(F.col("user_id").alias("site")), incidents, "ts", *day_limits(events, "ts")


def _event_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_outcome(*_event_sources(spark, sf_dir))


def _event_panel(spark: SparkSession, sf_dir: str, values: bool = False, ahead: bool = False) -> DataFrame:
    """Outcome, hazards of non-incident events and the forecast of three days before, from one scan of the events."""
    purchase = F.col("event_type") == "purchase"
    hazards = {n: F.when(F.col("event_type") != "purchase", v) for n, v in _hazard_values().items()} if values else {}
    return unfolded_panel(table(spark, sf_dir, "events"), "user_id", "ts", purchase, hazards, {"t_air": F.col("value")} if ahead else {}, 3)


@query("WITH" + EVENT_SPINE_SQL + ' SELECT site, "day", y FROM outcome')
def daily_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_panel(spark, sf_dir)


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event value as a temperature predicted for the day three days later."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site"), F.to_date("ts").alias("issue_day"), F.col("value").alias("t_air")
    )


@query('WITH' + EVENT_SPINE_SQL + """
SELECT o.site, o."day" AS "day", f.t_air
FROM outcome o LEFT JOIN (
  SELECT user_id, CAST(CAST(ts AS DATE) + INTERVAL 3 DAY AS DATE) AS due, max("value") AS t_air FROM events GROUP BY 1, 2
) f ON f.user_id = o.site AND f.due = o."day" """)
def lead_time_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_panel(spark, sf_dir, ahead=True).drop("y")


def _hazard_values() -> dict[str, Column]:
    return {"cos4": wave_incidence(F.col("value")), "hstp": F.col("value") * F.col("event_id") % 97}


def event_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, hazards of non-incident events, the forecast and the calendar, per user and day."""
    return with_calendar(_event_panel(spark, sf_dir, values=True, ahead=True))


EVENT_TABLE_SQL = 'WITH' + EVENT_SPINE_SQL + """,
hazards AS (
  SELECT user_id AS site, CAST(ts AS DATE) AS "day", max(pow(cos(radians(278.0 - "value")), 4)) AS cos4,
         max(("value" * event_id) % 97) AS hstp
  FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2),
due AS (
  SELECT user_id AS site, CAST(CAST(ts AS DATE) + INTERVAL 3 DAY AS DATE) AS "day", max("value") AS t_air
  FROM events GROUP BY 1, 2)
SELECT o.site, o."day" AS "day", o.y, round(h.cos4, 9) AS cos4, round(h.hstp, 6) AS hstp, d.t_air,
       CAST(day(o."day") AS INT) AS mday, CAST(month(o."day") AS INT) AS "month", CAST(isodow(o."day") AS INT) AS wday
FROM outcome o
LEFT JOIN hazards h ON h.site = o.site AND h."day" = o."day"
LEFT JOIN due d ON d.site = o.site AND d."day" = o."day" """


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"cos4": F.round("cos4", 9), "hstp": F.round("hstp", 6)})


@query(EVENT_TABLE_SQL)
def modelling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, hazards and forecast joined by site and day."""
    events = table(spark, sf_dir, "events").where("event_type <> 'purchase'")
    hazards = daily_max(events, "user_id", "ts", _hazard_values())
    days = lead_forecast(_event_outcome(spark, sf_dir), _forecasts(spark, sf_dir), "t_air", 3)
    return _rounded(modelling_table(days, hazards))


@query(EVENT_TABLE_SQL)
def modelling_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table from one scan, each event unfolded into its contributions."""
    return _rounded(event_model_table(spark, sf_dir))


@query(EVENT_TABLE_SQL)
def modelling_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table from one aggregate of several sources, as where sites, incidents and observations come apart."""
    events = table(spark, sf_dir, "events").where("event_type <> 'purchase'")
    hazards = events.select(
        F.col("user_id").alias("site"), F.to_date("ts").alias("day"), *[v.alias(n) for n, v in _hazard_values().items()]
    )
    due = _forecasts(spark, sf_dir).select("site", F.date_add("issue_day", 3).alias("day"), "t_air")
    return _rounded(with_calendar(daily_panel(*_event_sources(spark, sf_dir), [hazards, due])))


def _scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = day_limits(table(spark, sf_dir, "lineitem"), "l_shipdate")
    days = with_calendar(fill_days(_site_days(spark, sf_dir), *limits, zero=["y"]))
    return days.withColumn("risk", rule_risk(F.col("month"), F.col("t_air"), F.col("hstp"))).withColumn(
        "truth", F.when(F.col("y") == 1, POSITIVE).otherwise("pas_de_noyade")
    )


@query("WITH" + SITE_DAYS_SQL + """,
limits AS (SELECT min("day") AS lo, max("day") AS hi FROM site_days),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS "day" FROM limits)
SELECT s.site, d."day" AS "day", coalesce(o.y, 0) AS y, """ + SEASON_RULE_SQL.replace('month("day")', 'month(d."day")') + """ AS risk
FROM (SELECT DISTINCT site FROM site_days) s CROSS JOIN days d
LEFT JOIN site_days o ON o.site = s.site AND o."day" = d."day" """)
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_days(spark, sf_dir).select("site", "day", "y", "risk")


@query("WITH" + SITE_DAYS_SQL + """,
scored AS (SELECT y, """ + SEASON_RULE_SQL + """ AS risk FROM site_days),
c AS (
  SELECT count(*) FILTER (WHERE y = 1 AND risk = 'noyade') AS tp, count(*) FILTER (WHERE y = 0 AND risk = 'noyade') AS fp,
         count(*) FILTER (WHERE y = 1 AND risk <> 'noyade') AS fn, count(*) FILTER (WHERE y = 0 AND risk <> 'noyade') AS tn
  FROM scored WHERE risk IS NOT NULL)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
       round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f_meas, round(tp / nullif(tp + fp, 0), 9) AS ppv,
       round(tn / nullif(tn + fn, 0), 9) AS npv
FROM c""")
def rule_flag_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the fixed rule flags incident days, over the whole calendar of every site."""
    counts = confusion_counts(_scored_days(spark, sf_dir), "truth", "risk")
    metrics = count_metrics(counts, ["tp", "fp", "fn", "tn"])
    return metrics.withColumns({m: F.round(m, 9) for m in ("accuracy", "f_meas", "ppv", "npv")})


@query("WITH" + SITE_DAYS_SQL + """,
scored AS (SELECT "day", y, """ + SEASON_RULE_SQL + """ AS risk FROM site_days),
grid AS (SELECT * FROM (VALUES ('cell_1_1', 1, 'noyade'), ('cell_2_1', 1, 'pas_de_noyade'),
                               ('cell_1_2', 0, 'noyade'), ('cell_2_2', 0, 'pas_de_noyade')) g(name, y, prediction)),
months AS (SELECT DISTINCT CAST(month("day") AS INT) AS m FROM scored WHERE risk IS NOT NULL)
SELECT months.m AS "month", g.name, count(s.y) AS "value",
       CASE WHEN g.y = 1 THEN 'noyade' ELSE 'pas_de_noyade' END AS truth, g.prediction
FROM months CROSS JOIN grid g
LEFT JOIN scored s ON month(s."day") = months.m AND s.y = g.y AND s.risk = g.prediction
GROUP BY ALL""")
def rule_confusion_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = with_calendar(_site_days(spark, sf_dir))
    scored = observed.select(
        "month",
        F.when(F.col("y") == 1, POSITIVE).otherwise("pas_de_noyade").alias("truth"),
        rule_risk(F.col("month"), F.col("t_air"), F.col("hstp")).alias("risk"),
    )
    return confusion_cells(confusion_counts(scored, "truth", "risk", ["month"]), ["month"])


MAJORITY_SQL = "WITH" + SITE_DAYS_SQL + """
SELECT site, "day",
       CASE WHEN (CASE WHEN t_air > 20 OR hstp > 0.5 THEN 1 ELSE 0 END)
               + (CASE WHEN month("day") IN (7, 8) THEN CASE WHEN t_air > 15 OR hstp > 1.0 THEN 1 ELSE 0 END
                       ELSE CASE WHEN t_air > 25 OR hstp > 2.0 THEN 1 ELSE 0 END END)
               + (CASE WHEN t_air > 30 OR hstp > 3.0 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS decision
FROM site_days"""
# Three rule trees: (temperature, wave) cuts in summer and in other months.
TREES = (((20.0, 0.5), (20.0, 0.5)), ((15.0, 1.0), (25.0, 2.0)), ((30.0, 3.0), (30.0, 3.0)))


def _tree_votes() -> list[Column]:
    month, t_air, wave = F.col("month"), F.col("t_air"), F.col("hstp")
    return [rule_risk(month, t_air, wave, summer, other) == POSITIVE for summer, other in TREES]


@query(MAJORITY_SQL)
def majority_of_rule_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes of a row's trees side by side: no shuffle after the daily maxima."""
    observed = with_calendar(_site_days(spark, sf_dir))
    return observed.select("site", "day", majority(_tree_votes()).alias("decision"))


@query(MAJORITY_SQL)
def majority_of_vote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one row per vote, as separately scored models would give.

    Site-days are dealt anew before the votes unfold: else the tables of three aggregates, over large partitions, stand in one task.
    """
    observed = with_calendar(_site_days(spark, sf_dir)).repartition(shuffle_partitions(spark), "day", "site")
    votes = F.explode(F.array(*[v.cast("int") for v in _tree_votes()])).alias("vote")
    return majority_vote(observed.select("site", "day", votes), ["site", "day"])


# Fixed coefficients, as a stored model would have.
DAILY_MODEL = {"cos4": 0.8, "hstp": 0.35, "t_air": 0.04, "month": -0.05, "wday": 0.02}
DAILY_INTERCEPT = -2.0


@query("WITH" + SITE_DAYS_SQL + """
SELECT site, "day", round(1 / (1 + exp(-(-2.0 + 0.8 * cos4 + 0.35 * hstp + 0.04 * t_air
       - 0.05 * month("day") + 0.02 * isodow("day")))), 9) AS p
FROM site_days""")
def daily_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = with_calendar(_site_days(spark, sf_dir))
    return observed.select("site", "day", F.round(logistic(DAILY_INTERCEPT, DAILY_MODEL), 9).alias("p"))
