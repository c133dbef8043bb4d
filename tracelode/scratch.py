"""Intermediate tables and small files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_swept: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) is
    a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    here = spark.sparkContext.getCheckpointDir()
    if here is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors would not see the driver's temporary folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracelode-"))
        here = spark.sparkContext.getCheckpointDir()
    return here.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created.

    All paths of an application lie in one folder, which goes when the driver's
    Python ends.
    """
    home = f"{shared_dir(spark)}/tracelode/{spark.sparkContext.applicationId}"
    if home not in _swept:
        _swept.add(home)
        atexit.register(_sweep, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home), spark.sparkContext._jsc.hadoopConfiguration())
    return f"{home}/{label}-{uuid.uuid4().hex}"


def _sweep(path, conf) -> None:
    # the JVM may be gone by then; what is left is only scratch data
    with contextlib.suppress(Exception):
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage into ``df``: a lost executor costs a re-read.
    With ``release`` the shuffle files of the write go as soon as it ends,
    as nothing reads them again, rather than when the driver next collects garbage.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true" if release else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a small file from the driver, into whatever store the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path
