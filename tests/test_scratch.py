"""Intermediate tables: where they lie, and that they go."""

from types import SimpleNamespace

import pytest

from tracelode import scratch


def test_materialized_rows_outlive_their_plan(spark):
    df = scratch.materialize(spark.range(10).withColumnRenamed("id", "k"), "numbers", release=True)
    assert df.columns == ["k"] and df.count() == 10
    path = df.inputFiles()[0]
    assert f"/tracelode/{spark.sparkContext.applicationId}/numbers-" in path


def test_sweep_deletes_a_folder_and_never_raises(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b").write_text("x")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for _ in range(2):
        scratch._sweep(jvm.org.apache.hadoop.fs.Path(str(tmp_path / "a")), conf)
        assert not (tmp_path / "a").exists()
    scratch._sweep(None, None)


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
        scratch.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/x/"}, sparkContext=context)
    assert scratch.shared_dir(named) == "/shared/x"


def test_put_writes_bytes(spark, tmp_path):
    path = scratch.put(spark, f"file://{tmp_path}/deep/down.bin", b"\x00\xffabc")
    assert (tmp_path / "deep" / "down.bin").read_bytes() == b"\x00\xffabc" and path.endswith("down.bin")
