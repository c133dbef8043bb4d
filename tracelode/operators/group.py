"""Group-by and top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import number
from ..plans.predicate import _named, where


def group_by(df: DataFrame, by: int | str, agg: int | str, filter_text: str | None = None) -> DataFrame:
    """(category, count, sum, mean, min, max) of one measure by one trimmed text key.

    Empty keys and rows without a number are left out.
    """
    if filter_text:
        df = where(df, filter_text)
    key, _ = _named(df, by)
    value, kind = _named(df, agg)
    rows = df.select(F.trim(key.cast("string")).alias("category"), number(kind, value).alias("v"))
    return (
        rows.where("category <> '' AND v IS NOT NULL")
        .groupBy("category")
        .agg(
            F.count("*").alias("count"),
            F.sum("v").alias("sum"),
            F.avg("v").alias("mean"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
    )


def by_count(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("count"), "category")


def top_by_sum(groups: DataFrame, n: int = 50) -> DataFrame:
    """The report's order: the ``n`` groups of the largest sums."""
    return groups.orderBy(F.desc("sum"), "category").limit(n)


def top_n(
    df: DataFrame, column: int | str, n: int = 10, descending: bool = False, filter_text: str | None = None, tie: list[str] | None = None
) -> DataFrame:
    """The ``n`` rows of the least (or greatest) numbers; ties by ``tie`` or else all columns."""
    if filter_text:
        df = where(df, filter_text)
    value, kind = _named(df, column)
    v = number(kind, value)
    order = [v.desc() if descending else v.asc(), *[F.col(f"`{c}`") for c in (tie or df.columns)]]
    return df.where(v.isNotNull()).orderBy(*order).limit(n)
