"""Trees by histograms on labelled documents, and the SQL that grows the same trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.trees import Model, fit_trees, score_trees, tune_trees
from tidemark.operators.evaluate import metrics_long
from tidemark.plans.registry import query
from tidemark.plans.tables import table
from tidemark.session import materialise

FEATURES = ["size", "language", "rest"]
FOLDS = 5
ROWS_SQL = """
r AS (
  SELECT doc_id AS id, [least(n_chars // 500, 20), CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END, doc_id % 3] AS b,
         CAST((n_chars > 1500) = (quality = 1) AS INT) AS y, doc_id % 5 AS fold
  FROM labels JOIN documents USING (doc_id))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    language = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    rows = rows.select(
        "doc_id",
        F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).alias("size"),
        language.alias("language"),
        (F.col("doc_id") % 3).alias("rest"),
        ((F.col("n_chars") > 1500) == (F.col("quality") == 1)).cast("int").alias("y"),
        (F.col("doc_id") % FOLDS).cast("int").alias("fold"),
    )
    return materialise(rows, "rows")


def _grown_sql(rows: str, depth: int, name: str) -> str:
    """CTEs that grow one tree for each model ``m`` over ``rows`` (m, id, b, n, s, h, min_n, ...), and ``{name}_leaf`` with each row's ``value``.

    Every level counts rows and sums by (model, node, feature, value), and moves rows along the best cut of their node.
    """
    out = [f"{name}_p0 AS (SELECT *, 0 AS node FROM {rows})"]
    for k in range(depth):
        out.append(f"""
{name}_h{k} AS (
  SELECT m, node, f, v, any_value(min_n) AS min_n, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(s) AS DOUBLE) AS s
  FROM (SELECT m, node, min_n, n, s, unnest(range(len(b))) AS f, unnest(b) AS v FROM {name}_p{k} WHERE node >= {2**k - 1}) GROUP BY m, node, f, v),
{name}_c{k} AS (
  SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY m, node, f) AS na, sum(s) OVER (PARTITION BY m, node, f) AS sa
  FROM {name}_h{k} WINDOW w AS (PARTITION BY m, node, f ORDER BY v)),
{name}_g{k} AS (
  SELECT m, node, f, v, round((sl / 1e6) * (sl / 1e6) / nl + ((sa - sl) / 1e6) * ((sa - sl) / 1e6) / (na - nl) - (sa / 1e6) * (sa / 1e6) / na, 9) AS gain
  FROM {name}_c{k} WHERE nl >= min_n AND na - nl >= min_n AND na > nl),
{name}_t{k} AS (SELECT * FROM {name}_g{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY m, node ORDER BY gain DESC, f, v) = 1),
{name}_p{k + 1} AS (
  SELECT p.* REPLACE (CASE WHEN t.f IS NULL THEN p.node ELSE 2 * p.node + 1 + CAST(p.b[t.f + 1] > t.v AS INT) END AS node)
  FROM {name}_p{k} p LEFT JOIN {name}_t{k} t USING (m, node))""")
    out.append(f"""
{name}_leaf AS (SELECT *, CAST(sum(s) OVER (PARTITION BY m, node) AS DOUBLE) / sum(h) OVER (PARTITION BY m, node) AS value FROM {name}_p{depth})""")
    return ",".join(out)


def _round_sql(source: str, name: str, sums: str) -> str:
    """Rows with n, s and h from ``y``, the score ``x`` so far and ``used``."""
    s, h = ("y - p", "p * (1 - p)") if sums == "boosted" else ("y", "1")
    return f"""
{name} AS (
  SELECT * EXCLUDE (p), CAST(used AS INT) AS n, CASE WHEN used THEN CAST(round(1e6 * ({s})) AS BIGINT) ELSE 0 END AS s, CASE WHEN used THEN CAST(round(1e6 * ({h})) AS BIGINT) ELSE 0 END AS h
  FROM (SELECT *, 1 / (1 + exp(-x)) AS p FROM {source}))"""


def _boosted_sql(source: str, depth: int, rounds: int) -> str:
    """CTEs from rows (m, id, b, y, used, min_n, rate, x = 0) to ``b{rounds}``, where ``x`` is the boosted score."""
    out = [f"b0 AS (SELECT * FROM {source})"]
    for k in range(rounds):
        out += [_round_sql(f"b{k}", f"q{k}", "boosted"), _grown_sql(f"q{k}", depth, f"t{k}"), f"b{k + 1} AS (SELECT * EXCLUDE (n, s, h, node, value) REPLACE (x + rate * value AS x) FROM t{k}_leaf)"]
    return ",".join(out)


BY_FEATURES = "b[1] AS size, b[2] AS language, b[3] AS rest, count(*) AS n"


def _by_features(scored: DataFrame) -> DataFrame:
    keys = [F.col(c).cast("bigint").alias(c) for c in FEATURES]
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 6).alias("p"))


@query("WITH" + ROWS_SQL + ", one AS (SELECT 0 AS m, id, b, y, true AS used, 5 AS min_n, 0.0::DOUBLE AS x FROM r),"
       + _round_sql("one", "q", "forest") + "," + _grown_sql("q", 3, "t") + f" SELECT {BY_FEATURES}, round(max(value), 6) AS p FROM t_leaf GROUP BY b")
def histogram_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of depth three on all rows: the share of each leaf."""
    rows = _rows(spark, sf_dir)
    return _by_features(score_trees(fit_trees(rows, "doc_id", FEATURES, [Model("forest", depth=3, min_n=5)]), rows))


@query("WITH" + ROWS_SQL + ", one AS (SELECT 0 AS m, id, b, y, true AS used, 5 AS min_n, 0.3::DOUBLE AS rate, 0.0::DOUBLE AS x FROM r),"
       + _boosted_sql("one", 2, 3) + f" SELECT {BY_FEATURES}, round(max(1 / (1 + exp(-x))), 6) AS p FROM b3 GROUP BY b")
def boosted_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of boosting with trees of depth two."""
    rows = _rows(spark, sf_dir)
    model = Model("boosted", trees=3, depth=2, min_n=5, learn_rate=0.3)
    return _by_features(score_trees(fit_trees(rows, "doc_id", FEATURES, [model]), rows))


GRID = [
    Model("forest", depth=1),
    Model("forest", depth=2, min_n=20),
    Model("boosted", trees=1, depth=1, learn_rate=0.5),
    Model("boosted", trees=2, depth=1, min_n=20, learn_rate=0.5),
]
_HELD_OUT = """SELECT m // 5 AS config_id, m % 5 AS fold, y, {p} AS p FROM {source} WHERE NOT used"""


@query("WITH" + ROWS_SQL + """,
c AS (SELECT * FROM (VALUES (0, 1), (1, 20), (2, 1), (3, 20)) v(config_id, min_n)),
given AS (
  SELECT config_id * 5 + k AS m, config_id, id, b, y, fold <> k AS used, min_n, 0.5::DOUBLE AS rate, 0.0::DOUBLE AS x FROM r, c, range(5) f(k)),
f0 AS (SELECT * FROM given WHERE config_id = 0), f1 AS (SELECT * FROM given WHERE config_id = 1),
boosted AS (SELECT * FROM given WHERE config_id >= 2),""" + _round_sql("f0", "g0", "forest") + "," + _grown_sql("g0", 1, "u0") + ","
       + _round_sql("f1", "g1", "forest") + "," + _grown_sql("g1", 2, "u1") + "," + _boosted_sql("boosted", 1, 2) + ", scored AS ("
       + " UNION ALL ".join([_HELD_OUT.format(source="u0_leaf", p="value"), _HELD_OUT.format(source="u1_leaf", p="value"),
                             _HELD_OUT.format(source="b1", p="1 / (1 + exp(-x))") + " AND config_id = 2", _HELD_OUT.format(source="b2", p="1 / (1 + exp(-x))") + " AND config_id = 3"])
       + """),
folds AS (
  SELECT config_id, fold, avg(CAST((p >= 0.5) = (y = 1) AS INT)) AS accuracy,
         avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE -ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) AS mn_log_loss
  FROM scored GROUP BY config_id, fold)
SELECT CAST(config_id AS INT) AS config_id, round(avg(accuracy), 6) AS accuracy, round(avg(mn_log_loss), 6) AS mn_log_loss FROM folds GROUP BY config_id""")
def tree_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy and loss over five folds of four configurations, all of which are fitted by the same jobs."""
    held_out = tune_trees(_rows(spark, sf_dir), "doc_id", FEATURES, GRID, FOLDS, "fold")
    found = metrics_long(materialise(held_out, "held-out"), "y", "p", ["config_id", "fold"]).where("metric in ('accuracy', 'mn_log_loss')")
    means = found.groupBy("config_id").pivot("metric", ["accuracy", "mn_log_loss"]).agg(F.avg("value"))
    return means.select("config_id", F.round("accuracy", 6).alias("accuracy"), F.round("mn_log_loss", 6).alias("mn_log_loss"))
