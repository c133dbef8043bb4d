"""Sinks: filtered CSV, JSON and raw line exports, address reports, block hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ioc import report_lines
from ..plans.predicate import select_rows

BLOCK = 64 << 20
#: Rows whose offsets are summed in one task.
STRETCH = 1 << 20


def export_csv(df: DataFrame, path: str, order: str | None = None, single: bool = False, **predicates) -> None:
    """Rows that meet the predicates, with a header; in source order if ``order`` is given."""
    rows = select_rows(df, **predicates)
    if order:
        rows = rows.orderBy(order)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str, order: str | None = None, single: bool = False, **predicates) -> None:
    """Rows that meet the predicates as objects of text values, one a line, keys in schema order."""
    rows = select_rows(df, **predicates)
    if order:
        rows = rows.orderBy(order)
    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
    (text.coalesce(1) if single else text).write.mode("overwrite").json(path)


def json_array(df: DataFrame, limit: int) -> str:
    """At most ``limit`` rows as one JSON array of objects of text values, for small results on the driver."""
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).limit(limit)
    return "[" + ",".join(r[0] for r in text.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in text.columns]))).collect()) + "]"


def export_matches(lines: DataFrame, query: str, path: str, line_col: str = "line", ignore_case: bool = False) -> None:
    """Lines that hold ``query``, of all files together."""
    line = F.lower(line_col) if ignore_case else F.col(line_col)
    lines.where(F.contains(line, F.lit(query.lower() if ignore_case else query))).select(F.col(line_col).alias("value")).write.mode("overwrite").text(path)


def export_ip_report(ranked: DataFrame, path: str, shown: int = 1000) -> None:
    report_lines(ranked.orderBy(F.desc("count"), "ip").limit(shown)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def row_index(lines: DataFrame) -> DataFrame:
    """(file, row_idx, offset, length): where each line lies, for lines that end in one byte."""
    from pyspark.sql import Window as W

    rows = lines.select("file", "row_idx", F.octet_length("line").cast("long").alias("length"))
    # sums within stretches of rows, and before each stretch: no file passes through one task
    rows = rows.withColumn("__s", F.floor(F.col("row_idx") / F.lit(STRETCH)))
    sums = rows.groupBy(F.col("file").alias("__f"), F.col("__s").alias("__t")).agg(F.sum(F.col("length") + 1).alias("__n"))
    base = F.sum("__n").over(W.partitionBy("__f").orderBy("__t").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("__f", "__t", F.coalesce(base, F.lit(0)).alias("__base"))
    own = F.sum(F.col("length") + 1).over(W.partitionBy("file", "__s").orderBy("row_idx").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("__own", F.coalesce(own, F.lit(0)))
    both = placed.join(sums, (F.col("file") == F.col("__f")) & (F.col("__s") == F.col("__t")))
    return both.select("file", "row_idx", (F.col("__base") + F.col("__own")).alias("offset"), "length")


def block_hashes(spark: SparkSession, paths: list[str] | str, size: int = BLOCK) -> DataFrame:
    """(file, block, length, sha256) of blocks of ``size`` bytes."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(content.as_buffer())
                parts = [data[at : at + size] for at in range(0, len(data), size)]
                yield pa.record_batch(
                    [pa.array([path] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())],
                    ["file", "block", "length", "sha256"],
                )

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "file string, block bigint, length bigint, sha256 string")
