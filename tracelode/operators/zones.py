"""Zone maps: number ranges of row blocks, and filters that skip blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import number

ZONE_ROWS = 65_536


def zone_map(df: DataFrame, columns: Sequence[str], row_col: str = "row_idx", size: int = ZONE_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """(by..., zone, start_row, end_row, min_<column>, max_<column>...) of blocks of ``size`` rows.

    Partial aggregates by block: nothing is sorted.
    """
    kinds = dict(df.dtypes)
    zone = F.floor(F.col(row_col) / F.lit(size)).cast("long").alias("zone")
    ends = [f(number(kinds[c], F.col(c))).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by, zone).agg(F.min(row_col).alias("start_row"), (F.max(row_col) + 1).alias("end_row"), *ends)


def may_hold(column: str, low: float | None, high: float | None) -> Column:
    """Over zones: whether a zone can have a value within [low, high]."""
    out = F.col(f"min_{column}").isNotNull()
    if low is not None:
        out = out & (F.col(f"max_{column}") >= low)
    if high is not None:
        out = out & (F.col(f"min_{column}") <= high)
    return out


def pruned(df: DataFrame, zones: DataFrame, column: str, low: float | None, high: float | None, row_col: str = "row_idx", size: int = ZONE_ROWS) -> DataFrame:
    """Rows with ``column`` in [low, high], reading only zones that may hold one; the same rows as the plain filter."""
    kind = dict(df.dtypes)[column]
    v = number(kind, F.col(column)) if kind == "string" else F.col(column)
    inside = v.isNotNull()
    if low is not None:
        inside = inside & (v >= low)
    if high is not None:
        inside = inside & (v <= high)
    kept = zones.where(may_hold(column, low, high)).select("zone")
    own = df.where(inside).withColumn("__zone", F.floor(F.col(row_col) / F.lit(size)).cast("long"))
    return own.join(kept, F.col("__zone") == F.col("zone"), "left_semi").drop("__zone")


def save(zones: DataFrame, path: str) -> None:
    zones.write.mode("overwrite").parquet(path)


def load(spark, path: str, columns: Sequence[str]) -> DataFrame:
    """A saved map; raises if it is not over just these columns."""
    zones = spark.read.parquet(path)
    have = {c.removeprefix("min_") for c in zones.columns if c.startswith("min_")}
    if have != set(columns):
        raise ValueError(f"zone map is over {sorted(have)}, not {sorted(columns)}")
    return zones
