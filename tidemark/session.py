"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}
_OWN_DIRS: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the configured number, but never fewer than there are cores."""
    configured = (
        spark.conf.get("spark.sql.shuffle.partitions", "200"),
        spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or "0",
    )
    return max(spark.sparkContext.defaultParallelism, *map(int, configured))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_DIRS[application]


def _application_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one, removed when the application ends.

    What is written there only serves frames of this application.
    """
    application = spark.sparkContext.applicationId
    if application not in _OWN_DIRS:
        folder = os.path.join(shared_dir(spark), f"tidemark-{application}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN_DIRS[application] = folder
    return _OWN_DIRS[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in one folder per application."""
    return os.path.join(_application_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For frames that several later passes read. The files outlive lost executors and cut the lineage.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
