"""Icon dictionaries taken from style sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.documents import read_texts

RULE = r'\.fa-([a-z0-9-]+)::?before\s*\{\s*content:\s*"\\([0-9a-fA-F]+)'


def parse_icons(sheets: DataFrame) -> DataFrame:
    """(path, text) to distinct rows (icon, codepoint): a name with two code points keeps the smaller."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(RULE), F.lit(1)).alias("icon"),
        F.regexp_extract_all("text", F.lit(RULE), F.lit(2)).alias("codepoint"),
    )
    return sheets.select(F.inline(pairs)).groupBy("icon").agg(F.min("codepoint").alias("codepoint"))


def read_icons(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_icons(read_texts(spark, paths))
