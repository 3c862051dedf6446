"""Views of the given tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.risk import wave_factor, wave_incidence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table whose rows are dear to read, over all cores if it has fewer files than those.

    A file may be one row group, which one task reads. Tables of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def line_values() -> dict[str, Column]:
    """lineitem as coastal observations.

    The supplier is the site, quantity serves as swell direction and height, discount as period, the
    scaled price as air temperature, and a returned item as an incident.
    """
    return {
        "cos4": wave_incidence(F.col("l_quantity")),
        "hstp": wave_factor(F.col("l_quantity"), F.col("l_discount")),
        "t_air": F.col("l_extendedprice") / 2500.0,
        "y": F.when(F.col("l_returnflag") == "R", 1).otherwise(0),
    }


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: truth ``y`` and a score ``p`` that grows with their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))
    return labels.join(docs, "doc_id").withColumn("p", score)
