"""Readers of files: collections that Spark writes from ``documents`` into the shared folder, read back whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.decks import BIB, DECK, ICONS_SQL, SHEET
from tidemark.plans.registry import query
from tidemark.plans.tables import dealt, table
from tidemark.session import fresh_path
from tidemark.sources.bibliography import read_bibliography
from tidemark.sources.documents import read_documents
from tidemark.sources.icons import read_icons


def _written(spark: SparkSession, sf_dir: str, text: str, name: str, by: list[str]) -> str:
    """The folder of a collection with a text for each document, in files below ``by``."""
    path = fresh_path(spark, name)
    rows = dealt(table(spark, sf_dir, "documents")).select(*by, F.expr(text).alias("text"))
    rows.write.partitionBy(*by).text(path)
    return path


@query(f"""
SELECT lang, source, count(*) AS decks, CAST(sum(length({DECK}) + 1) AS BIGINT) AS chars
FROM documents WHERE lang <> 'es' AND source <> 'src7' GROUP BY lang, source""")
def documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks by language and source, read from files by include and exclude patterns."""
    root = _written(spark, sf_dir, DECK, "decks", ["lang", "source"])
    files = read_documents(spark, root, ["*.txt", "!lang=es/", "!**/source=src7/"])
    place = r"^lang=([^/]*)/source=([^/]*)/[^/]*$"
    rows = files.select(*[F.regexp_extract("path", place, k).alias(c) for k, c in ((1, "lang"), (2, "source"))], "text")
    count = F.sum(F.regexp_count("text", F.lit(r"(?m)^title: \"Report \d+ :star2:\"$")))
    return rows.groupBy("lang", "source").agg(count.alias("decks"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT source, kind, count(*) AS entries, CAST(sum(CASE kind WHEN 'article' THEN 5 ELSE 1 END) AS BIGINT) AS fields
FROM documents, (VALUES ('article'), ('techreport')) k(kind) GROUP BY source, kind""")
def bibliography_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and fields of the bibliography files of each source."""
    entries = read_bibliography(spark, _written(spark, sf_dir, BIB, "bibliographies", ["source"]))
    source = F.regexp_extract("path", r"/source=([^/]*)/[^/]*$", 1)
    return entries.groupBy(source.alias("source"), "kind").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("fields")).cast("bigint").alias("fields"))


@query("WITH" + ICONS_SQL + " SELECT icon, codepoint FROM icons")
def icons_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The icon dictionary of style sheets in files."""
    return read_icons(spark, _written(spark, sf_dir, SHEET, "sheets", ["source"]))
