"""Where written stages go."""

from types import SimpleNamespace

import pytest

from tidemark import session


def fake(master, folder=None, dropped=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    files = SimpleNamespace(mkdirs=lambda path: True, deleteOnExit=[].append if dropped is None else dropped.append)
    path = lambda name: SimpleNamespace(name=name, getFileSystem=lambda settings: files)
    hadoop = SimpleNamespace(fs=SimpleNamespace(Path=path))
    jvm = SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=hadoop)))
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(conf=conf, sparkContext=context, _jvm=jvm, _jsc=SimpleNamespace(hadoopConfiguration=lambda: None))


def test_the_named_folder_is_used_and_dropped_at_the_end(monkeypatch):
    monkeypatch.setattr(session, "_OWN_DIRS", {})
    assert session.shared_dir(fake("spark://host", "hdfs://x/y")) == "hdfs://x/y"
    dropped = []
    for _ in range(2):
        assert session.fresh_path(fake("yarn", "hdfs://x/y", dropped), "a").startswith("hdfs://x/y/tidemark-app-1/a-")
    assert [d.name for d in dropped] == ["hdfs://x/y/tidemark-app-1"]


def test_only_local_sessions_may_fall_back(tmp_path, monkeypatch):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    assert session.shared_dir(fake("local[2]")) == str(tmp_path)
    with pytest.raises(ValueError):
        session.shared_dir(fake("spark://host"))


def test_materialise_reads_back_the_same_rows(spark):
    df = spark.range(10).selectExpr("id", "array(id, id + 1) AS a", "CAST(NULL AS string) AS s")
    back = session.materialise(df, "x")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back._jdf.queryExecution().toString().count("Range") == 0


def test_repartitions_use_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.shuffle_partitions(spark) == max(cores, 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "77")
    try:
        assert session.shuffle_partitions(spark) == 77
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
