"""Metrics, risk classes and model choice on labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.risk import FIFTHS, NEGATIVE, POSITIVE, risk_class
from tidemark.operators.evaluate import (
    HIGHER_IS_BETTER,
    best_config,
    class_table,
    confusion_cells,
    confusion_counts,
    confusion_wide,
    count_metrics,
    log_loss,
    metrics_long,
    roc_auc,
)
from tidemark.plans.registry import query
from tidemark.plans.tables import labelled
from tidemark.session import fresh_path
from tidemark.sources.cells import read_cells, write_cells

LABELLED_SQL = """
labelled AS (
  SELECT l.doc_id, d.lang, d.n_chars, l.quality AS y, d.n_chars / (d.n_chars + 2000.0) AS p
  FROM labels l JOIN documents d USING (doc_id))"""

# Half-saturation lengths: each one is a configuration of the length score.
HALF_LENGTHS = (250, 500, 1000, 2000, 4000, 8000)

CONFIG_SCORES_SQL = LABELLED_SQL + """,
scored AS (
  SELECT k AS config_id, y, n_chars / (n_chars + CAST(k AS DOUBLE)) AS p
  FROM labelled CROSS JOIN (VALUES (250), (500), (1000), (2000), (4000), (8000)) c(k)),
counts AS (
  SELECT config_id, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
         count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
         avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15))
                  ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) AS loss
  FROM scored GROUP BY config_id),
per_score AS (
  SELECT config_id, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
  FROM scored GROUP BY 1, 2),
cum AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY config_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM per_score),
auc AS (
  SELECT config_id, CAST(sum(pos * (nb + CAST(0.5 AS DOUBLE) * neg)) AS DOUBLE) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
  FROM cum GROUP BY config_id),
metrics AS (
  SELECT config_id, 'accuracy' AS metric, (tp + tn) / (tp + fp + fn + tn) AS v, 1 AS dir FROM counts
  UNION ALL SELECT config_id, 'roc_auc', auc, 1 FROM auc
  UNION ALL SELECT config_id, 'f_meas', 2 * tp / nullif(2 * tp + fp + fn, 0), 1 FROM counts
  UNION ALL SELECT config_id, 'mn_log_loss', loss, -1 FROM counts
  UNION ALL SELECT config_id, 'ppv', tp / nullif(tp + fp, 0), 1 FROM counts
  UNION ALL SELECT config_id, 'npv', tn / nullif(tn + fn, 0), 1 FROM counts),
best AS (
  SELECT metric, config_id, round(v, 9) AS "value"
  FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(dir * v, 12) DESC, config_id) AS rn
        FROM metrics WHERE v IS NOT NULL) WHERE rn = 1),
cells AS (
  SELECT b.metric, u.name, u."value" AS "value", u.truth, u.prediction
  FROM best b JOIN (
    SELECT config_id, 'cell_1_1' AS name, tp AS "value", 'noyade' AS truth, 'noyade' AS prediction FROM counts
    UNION ALL SELECT config_id, 'cell_2_1', fn, 'noyade', 'pas_de_noyade' FROM counts
    UNION ALL SELECT config_id, 'cell_1_2', fp, 'pas_de_noyade', 'noyade' FROM counts
    UNION ALL SELECT config_id, 'cell_2_2', tn, 'pas_de_noyade', 'pas_de_noyade' FROM counts) u USING (config_id))"""


def _scored_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document scored by every configuration, without a join: six copies of a narrow row."""
    k = F.explode(F.array(*[F.lit(k) for k in HALF_LENGTHS])).alias("config_id")
    rows = labelled(spark, sf_dir).select(k, "y", "n_chars")
    return rows.select("config_id", "y", (F.col("n_chars") / (F.col("n_chars") + F.col("config_id").cast("double"))).alias("p"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics_long(_scored_configs(spark, sf_dir), "y", "p", ["config_id"])
    # Rounding keeps values that differ only in their last bits tied.
    return best_config(scores.withColumn("value", F.round("value", 12)))


def _best_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long confusion matrix of the configuration chosen by each metric."""
    label = lambda positive: F.when(positive, POSITIVE).otherwise(NEGATIVE)
    named = _scored_configs(spark, sf_dir).select(
        "config_id", label(F.col("y") == 1).alias("truth"), label(F.col("p") >= 0.5).alias("prediction")
    )
    counts = confusion_counts(named, "truth", "prediction", ["config_id"])
    chosen = counts.join(_best(spark, sf_dir).select("metric", "config_id"), "config_id")
    return confusion_cells(chosen, ["metric"])


@query("WITH" + LABELLED_SQL + """
SELECT doc_id, round(p, 9) AS p,
       CASE WHEN p < 0.2 THEN 1 WHEN p < 0.4 THEN 2 WHEN p < 0.6 THEN 3 WHEN p < 0.8 THEN 4 ELSE 5 END AS risk_class
FROM labelled""")
def risk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", F.round("p", 9).alias("p"), risk_class(F.col("p")).alias("risk_class"))


@query("WITH" + LABELLED_SQL + """,
c AS (SELECT lang, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
             count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn
      FROM labelled GROUP BY lang)
SELECT lang, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
       round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f_meas, round(tp / nullif(tp + fp, 0), 9) AS ppv,
       round(tn / nullif(tn + fn, 0), 9) AS npv
FROM c""")
def threshold_metrics_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = labelled(spark, sf_dir).withColumn("flag", (F.col("p") >= 0.5).cast("int"))
    metrics = count_metrics(confusion_counts(flagged, "y", "flag", ["lang"], positive=1), ["lang"])
    return metrics.withColumns({m: F.round(m, 9) for m in ("accuracy", "f_meas", "ppv", "npv")})


@query("WITH" + LABELLED_SQL + """
SELECT round(avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15))
                      ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END), 9) AS mn_log_loss
FROM labelled""")
def mean_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_loss(labelled(spark, sf_dir), "y", "p").select(F.round("mn_log_loss", 9).alias("mn_log_loss"))


@query("WITH" + LABELLED_SQL + """,
per_score AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM labelled GROUP BY p),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM per_score)
SELECT round(CAST(sum(pos * (nb + CAST(0.5 AS DOUBLE) * neg)) AS DOUBLE) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0), 9) AS roc_auc
FROM cum""")
def area_under_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc_auc(labelled(spark, sf_dir), "y", "p").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("WITH" + LABELLED_SQL + """,
c AS (SELECT CASE WHEN p < 0.2 THEN 1 WHEN p < 0.4 THEN 2 WHEN p < 0.6 THEN 3 WHEN p < 0.8 THEN 4 ELSE 5 END AS rc, y FROM labelled)
SELECT g.rc AS risk_class, count(*) FILTER (WHERE c.y = 1) AS events, count(*) FILTER (WHERE c.y = 0) AS no_events
FROM (VALUES (1), (2), (3), (4), (5)) g(rc) LEFT JOIN c ON c.rc = g.rc GROUP BY g.rc""")
def risk_class_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(labelled(spark, sf_dir), "p", "y", FIFTHS)


@query("WITH" + CONFIG_SCORES_SQL + ' SELECT metric, config_id, "value" FROM best')
def best_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).withColumn("value", F.round("value", 9))


@query("WITH" + CONFIG_SCORES_SQL + """
SELECT metric, truth, CAST(sum("value") FILTER (WHERE prediction = 'noyade') AS BIGINT) AS noyade,
       CAST(sum("value") FILTER (WHERE prediction = 'pas_de_noyade') AS BIGINT) AS pas_de_noyade
FROM cells GROUP BY metric, truth""")
def confusion_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_wide(_best_cells(spark, sf_dir))


@query("WITH" + CONFIG_SCORES_SQL + """
SELECT CAST(row_number() OVER (ORDER BY metric, name) AS INT) AS row_id, metric, name, "value", truth, prediction FROM cells""")
def confusion_cells_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells written to, and read back from, the semicolon-separated format."""
    # Four cells for each of six metrics, so the numbering is one small partition by nature.
    order = Window.orderBy("metric", "name")
    assert len(HIGHER_IS_BETTER) == 6
    cells = _best_cells(spark, sf_dir).withColumn("row_id", F.row_number().over(order))
    path = fresh_path(spark, "cells")
    write_cells(cells, path)
    return read_cells(spark, path)
