"""Confusion cells as semicolon-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column order of the file. Its first header is empty, so names come from here.
SCHEMA = "row_id INT, metric STRING, name STRING, value BIGINT, truth STRING, prediction STRING"
FORMAT = {"sep": ";", "quote": '"', "header": True}


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).options(enforceSchema=True, mode="FAILFAST", **FORMAT).csv(path)


def write_cells(df: DataFrame, path: str) -> None:
    df.select("row_id", "metric", "name", "value", "truth", "prediction").write.options(quoteAll=True, **FORMAT).csv(path)
