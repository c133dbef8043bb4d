"""Scan history and comparison of profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = ("column", "count", "null_count", "mean", "distinct_count")


def record(profile: DataFrame, path: str, source: str, content_hash: str | None = None, tag: str | None = None, note: str | None = None) -> str:
    """Append a profile to the history at ``path``; returns the scan's id."""
    scan = uuid.uuid4().hex
    have = set(profile.columns)
    rows = profile.select(
        F.lit(scan).alias("scan_id"),
        F.lit(source).alias("source"),
        F.current_timestamp().alias("scanned_at"),
        F.lit(content_hash).cast("string").alias("content_hash"),
        F.lit(tag).cast("string").alias("tag"),
        F.lit(note).cast("string").alias("note"),
        *[(F.col(c) if c in have else F.lit(None)).cast("string" if c == "column" else "double" if c == "mean" else "bigint").alias(c) for c in _COLUMNS],
    )
    rows.write.mode("append").parquet(path)
    return scan


def scans(spark: SparkSession, path: str, holds: str = "") -> DataFrame:
    """(scan_id, source, scanned_at, content_hash, tag, note) of scans whose source holds a text, latest first."""
    rows = spark.read.parquet(path).where(F.contains("source", F.lit(holds)) if holds else F.lit(True))
    return rows.select("scan_id", "source", "scanned_at", "content_hash", "tag", "note").distinct().orderBy(F.desc("scanned_at"), "scan_id")


def latest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The rows of the last scan of ``source``."""
    rows = spark.read.parquet(path).where(F.col("source") == source)
    last = rows.agg(F.max_by("scan_id", "scanned_at").alias("last"))
    return rows.join(last, F.col("scan_id") == F.col("last"), "left_semi")


def delete(spark: SparkSession, path: str, source: str, new_path: str) -> int:
    """Write the history without the scans of ``source`` to ``new_path``; returns how many scans went."""
    rows = spark.read.parquet(path)
    gone = rows.where(F.col("source") == source).select("scan_id").distinct().count()
    rows.where(F.col("source") != source).write.mode("errorifexists").parquet(new_path)
    return gone


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, status, count, null share, mean and distinct count of both) by column.

    status: Changed for columns of both, OnlyInA or OnlyInB.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        total = F.col("count") + F.col("null_count")
        return df.select(
            F.col("column").alias(f"column_{s}"),
            F.col("count").alias(f"count_{s}"),
            F.coalesce(F.try_divide(F.col("null_count") * 100.0, total), F.lit(0.0)).alias(f"null_pct_{s}"),
            F.col("mean").alias(f"mean_{s}"),
            *([F.col("distinct_count").alias(f"distinct_{s}")] if "distinct_count" in df.columns else []),
        )

    both = side(a, "a").join(side(b, "b"), F.col("column_a") == F.col("column_b"), "full")
    status = F.when(F.col("column_b").isNull(), "OnlyInA").when(F.col("column_a").isNull(), "OnlyInB").otherwise("Changed")
    return both.select(F.coalesce("column_a", "column_b").alias("column"), status.alias("status"), *[c for c in both.columns if not c.startswith("column_")]).orderBy("column")


#: Bytes of a source from which scans are logged.
LARGE = 1_000_000_000


def log_telemetry(spark: SparkSession, path: str, source: str, size: int, rows: int, seconds: float, least: int = LARGE) -> bool:
    """Append a scan's rate to the CSV table at ``path`` if the source has ``least`` bytes; returns whether it did."""
    if size < least:
        return False
    row = [(source, size, rows, round(seconds, 3), round(size / 1e6 / max(seconds, 1e-9), 3), round(rows / max(seconds, 1e-9), 1))]
    log = spark.createDataFrame(row, "source string, bytes bigint, rows bigint, seconds double, mb_per_s double, rows_per_s double")
    log.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").csv(path, header=True)
    return True
