"""Preparation steps, over-sampling and designs on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.design import latin_hypercube
from tidemark.operators.hashed_neighbours import approximate_neighbours
from tidemark.operators.neighbours import nearest_neighbours
from tidemark.operators.oversample import smote
from tidemark.operators.prep import correlations, dummies, levels, stratified_split, uncorrelated, zscore
from tidemark.plans.evaluation import LABELLED_SQL
from tidemark.plans.registry import query
from tidemark.plans.tables import labelled, table
from tidemark.session import materialise

SPLIT_SQL = LABELLED_SQL + """,
hashed AS (SELECT *, CAST('0x' || substr(md5(doc_id || '|42'), 1, 8) AS BIGINT) AS h FROM labelled),
split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY h, doc_id) <= round(0.8 * count(*) OVER (PARTITION BY y))
                 THEN 'train' ELSE 'test' END AS split
  FROM hashed)"""


@query("WITH" + SPLIT_SQL + " SELECT doc_id, y, split FROM split")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(materialise(labelled(spark, sf_dir), "labelled"), "doc_id", "y").select("doc_id", "y", "split")


@query("WITH" + SPLIT_SQL + """,
s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS d, avg(p) AS pm, stddev_samp(p) AS pd FROM split WHERE split = 'train')
SELECT doc_id, split, round((n_chars - m) / d, 8) AS n_chars, round((p - pm) / pd, 8) AS p FROM split, s""")
def centred_and_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stratified_split(materialise(labelled(spark, sf_dir), "labelled"), "doc_id", "y").select("doc_id", "split", "n_chars", "p")
    scaled = zscore(rows, ["n_chars", "p"], rows.where("split = 'train'"))
    return scaled.withColumns({c: F.round(c, 8) for c in ("n_chars", "p")})


@query("""
SELECT doc_id, CAST(lang = 'en' AS INT) AS lang_en, CAST(lang = 'es' AS INT) AS lang_es, CAST(lang = 'fr' AS INT) AS lang_fr
FROM documents""")
def dummy_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return dummies(docs, "lang", levels(docs, "lang"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem"
        for i, a in enumerate(NUMBERS)
        for b in NUMBERS[i + 1 :]
    )
)
def predictor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations(table(spark, sf_dir, "lineitem"), NUMBERS).withColumn("r", F.round("r", 9))


PRICES = ("discounted", "l_discount", "l_extendedprice", "l_quantity", "l_tax", "taxed")
PRICE_EXPR = {
    "discounted": "l_extendedprice * (1 - l_discount)",
    "taxed": "l_extendedprice * (1 + l_tax) + l_quantity",
}


def _filter_sql(steps: int) -> str:
    """Greedy removal unrolled: each step drops one column of the worst pair while it exceeds 0.9."""
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM priced" for a in PRICES for b in PRICES if a != b
    )
    sql = f"""WITH priced AS (SELECT *, {PRICE_EXPR['discounted']} AS discounted, {PRICE_EXPR['taxed']} AS taxed FROM lineitem),
r0 AS ({pairs})"""
    for i in range(1, steps + 1):
        sql += f""",
worst{i} AS (SELECT a, b FROM r{i - 1} WHERE a < b AND r > 0.9 ORDER BY r DESC, a, b LIMIT 1),
drop{i} AS (
  SELECT m.a AS gone FROM (SELECT a, avg(r) AS mr FROM r{i - 1} GROUP BY a) m, worst{i} w
  WHERE m.a IN (w.a, w.b) ORDER BY m.mr DESC, m.a DESC LIMIT 1),
r{i} AS (SELECT * FROM r{i - 1} WHERE a NOT IN (SELECT gone FROM drop{i}) AND b NOT IN (SELECT gone FROM drop{i}))"""
    columns = ", ".join(f"('{c}')" for c in PRICES)
    gone = " UNION ALL ".join(f"SELECT gone FROM drop{i}" for i in range(1, steps + 1))
    return sql + f' SELECT c AS "column", c NOT IN ({gone}) AS kept FROM (VALUES {columns}) v(c)'


@query(_filter_sql(len(PRICES) - 1))
def correlation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = table(spark, sf_dir, "lineitem").withColumns({k: F.expr(v) for k, v in PRICE_EXPR.items()})
    kept = uncorrelated(priced, PRICES)
    return spark.createDataFrame([(c, c in kept) for c in PRICES], "column string, kept boolean")


@query("""
WITH n AS (SELECT count(*) AS n, min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS r0, max(p_retailprice) AS r1 FROM part),
d AS (
  SELECT p_partkey, dim, CAST('0x' || substr(md5(dim || '|' || p_partkey || '|42'), 1, 8) AS BIGINT) AS h,
         CAST('0x' || substr(md5(dim || '|' || p_partkey || '|42|u'), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM part CROSS JOIN (VALUES ('size'), ('price')) v(dim)),
x AS (SELECT p_partkey, dim, (row_number() OVER (PARTITION BY dim ORDER BY h, p_partkey) - 1 + CAST(u AS DOUBLE)) / n AS x FROM d, n)
SELECT p_partkey, round(max(s0 + x * (s1 - s0)) FILTER (WHERE dim = 'size'), 6) AS size,
       round(max(r0 + x * (r1 - r0)) FILTER (WHERE dim = 'price'), 6) AS price
FROM x, n GROUP BY p_partkey""")
def latin_hypercube_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    limit = lambda f, c: part.agg(f(F.col(c).cast("double")).alias("v")).scalar()
    ranges = {
        "size": (limit(F.min, "p_size"), limit(F.max, "p_size")),
        "price": (limit(F.min, "p_retailprice"), limit(F.max, "p_retailprice")),
    }
    points = latin_hypercube(part.select("p_partkey"), "p_partkey", ranges)
    return points.withColumns({c: F.round(c, 6) for c in ranges})


@query("""
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, CAST('0x' || substr(md5(vec_id || '|42'), 1, 8) AS BIGINT) AS h
  FROM embeddings WHERE embedding IS NOT NULL),
sizes AS (SELECT label, count(*) AS n FROM v GROUP BY label),
goal AS (SELECT label, n, (SELECT max(n) FROM sizes) - n AS missing FROM sizes),
copies AS (
  SELECT v.*, (missing // n) + CASE WHEN row_number() OVER (PARTITION BY v.label ORDER BY h, vec_id) <= missing % n THEN 1 ELSE 0 END AS c
  FROM v JOIN goal USING (label)),
pairs AS (
  SELECT a.vec_id, b.vec_id AS nb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rk,
         count(*) OVER (PARTITION BY a.vec_id) AS others
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
rows_ AS (SELECT *, unnest(generate_series(1, c)) AS copy FROM copies WHERE c > 0),
picked AS (
  SELECT r.label, r.vec_id, r.copy, r.x, p.nb,
         CAST('0x' || substr(md5(r.vec_id || '|' || r.copy || '|42|u'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM rows_ r JOIN pairs p ON p.vec_id = r.vec_id
   AND p.rk = CAST('0x' || substr(md5(r.vec_id || '|' || r.copy || '|42|k'), 1, 8) AS BIGINT) % least(5, others) + 1)
SELECT p.label, p.vec_id, CAST(p.copy AS INT) AS copy, p.nb AS nb_id, round(p.x[1] + u * (b.x[1] - p.x[1]), 6) AS first,
       round(list_sum(list_transform(generate_series(1, len(p.x)), lambda i: p.x[i] + u * (b.x[i] - p.x[i]))), 5) AS total
FROM picked p JOIN v b ON b.vec_id = p.nb""")
def smote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = smote(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return new.select(
        "label",
        "vec_id",
        "copy",
        "nb_id",
        F.round(F.col("embedding")[0], 6).alias("first"),
        F.round(total, 5).alias("total"),
    )


@query("""
SELECT label, count(*) AS asking, min(least(5, n - 1)) AS wanted FROM (
  SELECT label, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
WHERE n > 1 GROUP BY label""")
def hashed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each label ask for neighbours, and how many the hashed search gives each row at least, up to 5.

    Buckets as long as the whole spread of the data make it exact, which is what the SQL states.
    """
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    found = approximate_neighbours(rows, "label", "vec_id", "embedding", 5, tables=2, width=1, length=1e9)
    given = found.groupBy("g", "id").agg(F.count(F.lit(1)).alias("n"))
    return given.groupBy(F.col("g").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("asking"), F.min("n").alias("wanted"))


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
near AS (
  SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rk
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT true AS recalled, count(*) AS neighbours FROM near WHERE rk <= 5""")
def hashed_neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hashed search with its defaults finds at least nine tenths of the exact neighbours, and how many those are."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    exact = nearest_neighbours(rows, "label", "vec_id", "embedding", 5).select("g", "id", "nb_id")
    found = approximate_neighbours(rows, "label", "vec_id", "embedding", 5).select("g", "id", "nb_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["g", "id", "nb_id"], "left")
    return both.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"), F.count(F.lit(1)).alias("neighbours"))
