"""Append ingest, running moments and progress with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.profile import with_health


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream; ``glob`` picks file names."""
    reader = spark.readStream.schema(schema)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    if not status.isDirectory():  # a stream's base has to be a folder
        path, glob = target.getParent().toString(), target.getName()
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Append the stream's rows to Parquet at ``path``, exactly once.

    Runs until what is there has been read, or with ``continuous`` (an
    interval) until stopped.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


class Progress(StreamingQueryListener):
    """Counts rows and batches of running queries."""

    def __init__(self) -> None:
        self.rows = self.batches = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def power_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, nulls, s1..s4, low, high): sums that merge by addition, also over a stream."""
    cells = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.column", "x.v")
    v = F.col("v")
    return cells.groupBy(*by, "column").agg(
        F.count(v).alias("n"),
        F.count(F.when(v.isNull(), 1)).alias("nulls"),
        *[F.sum(F.pow(v, F.lit(k))).alias(f"s{k}") for k in range(1, 5)],
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )


def merge_sums(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Power sums of several batches as one."""
    return sums.groupBy(*by, "column").agg(
        *[F.sum(c).alias(c) for c in ("n", "nulls", "s1", "s2", "s3", "s4")], F.min("low").alias("low"), F.max("high").alias("high")
    )


def finish_sums(sums: DataFrame) -> DataFrame:
    """The numeric profile that power sums stand for."""
    n, mean = F.col("n").cast("double"), F.try_divide(F.col("s1"), F.col("n").cast("double"))
    m2 = F.col("s2") - n * mean * mean
    m3 = F.col("s3") - 3 * mean * F.col("s2") + 2 * n * F.pow(mean, F.lit(3))
    m4 = F.col("s4") - 4 * mean * F.col("s3") + 6 * mean * mean * F.col("s2") - 3 * n * F.pow(mean, F.lit(4))
    var = F.when(n > 1, m2 / (n - 1)).otherwise(0.0)
    flat = F.sqrt(var) < 1e-10
    skew = F.when((n > 2) & ~flat, n * m3 / ((n - 1) * (n - 2) * F.pow(F.sqrt(var), F.lit(3)))).otherwise(0.0)
    kurt = F.when(
        (n > 3) & ~flat,
        n * (n + 1) * m4 / ((n - 1) * (n - 2) * (n - 3) * var * var) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)),
    ).otherwise(0.0)
    out = sums.select(
        *[c for c in sums.columns if c not in ("n", "nulls", "s1", "s2", "s3", "s4", "low", "high")],
        F.col("n").alias("count"),
        F.coalesce(mean, F.lit(0.0)).alias("mean"),
        F.coalesce("low", F.lit(0.0)).alias("min"),
        F.coalesce("high", F.lit(0.0)).alias("max"),
        var.alias("variance"),
        F.sqrt(var).alias("std_dev"),
        F.coalesce(skew, F.lit(0.0)).alias("skewness"),
        F.coalesce(kurt, F.lit(0.0)).alias("kurtosis"),
        F.col("nulls").alias("null_count"),
        F.lit(False).alias("is_categorical"),
    )
    return with_health(out).drop("is_categorical")


def analyse_stream(stream: DataFrame, columns: Sequence[str], sums_dir: str, checkpoint: str) -> StreamingQuery:
    """Power sums of each micro-batch as one small file, named by batch so that a rerun overwrites it."""

    def keep(batch: DataFrame, number: int) -> None:
        power_sums(batch, columns).write.mode("overwrite").parquet(f"{sums_dir}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_profile(spark: SparkSession, sums_dir: str) -> DataFrame:
    return finish_sums(merge_sums(spark.read.parquet(sums_dir)))


def stream_group(stream: DataFrame, key: str, value: str, checkpoint: str) -> DataFrame:
    """Group-by over all that a stream holds now; the groups stay in the state store and are read from there."""
    groups = stream.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count"), F.sum(value).alias("sum"))
    query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    state = stream.sparkSession.read.format("statestore").load(checkpoint)
    count, total = state.schema["value"].dataType.names[:2]
    own = state.schema["key"].dataType.names[0]
    return state.select(F.col(f"key.`{own}`").alias(key), F.col(f"value.`{count}`").alias("count"), F.col(f"value.`{total}`").alias("sum"))


def windowed(stream: DataFrame, ts: str, keys: Sequence[str], width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Extension: counts by event-time window; rows later than ``lateness`` are left out."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width, slide), *keys).count()


def sessions(stream: DataFrame, ts: str, keys: Sequence[str], gap: str, lateness: str) -> DataFrame:
    """Extension: counts by session, which ends after ``gap`` without a row."""
    return stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *keys).count()
