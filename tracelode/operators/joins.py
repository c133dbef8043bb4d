"""Equi-joins by column name, index pairs and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import unquote
from ..plans.predicate import _named

#: Extensions beyond inner, left and right are plain Spark join types.
KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def _key(df: DataFrame, column: int | str, clean: bool) -> Column:
    col, kind = _named(df, column)
    if kind != "string":
        return col
    return unquote(col) if clean else col


def join(
    left: DataFrame,
    right: DataFrame,
    left_on: int | str,
    right_on: int | str,
    how: str = "inner",
    match_empty_keys: bool = False,
    fill: str | None = None,
    clean: bool = True,
    right_prefix: str = "right_",
) -> DataFrame:
    """All columns of ``left``, then all of ``right`` (renamed where the name is taken); both keys stay.

    Text keys are compared trimmed and unquoted, with case.  Empty and null
    keys match nothing unless ``match_empty_keys``.  ``fill`` replaces the
    nulls of unmatched text cells.  Spark picks the physical join from sizes.
    """
    if how not in KINDS:
        raise ValueError(f"unknown join kind {how!r}")
    # keys become columns, so that both sides are dealt by them
    l, r = left.withColumn("__lk", _key(left, left_on, clean)), right.withColumn("__rk", _key(right, right_on, clean))
    if l.schema["__lk"].dataType != r.schema["__rk"].dataType and "string" in (l.schema["__lk"].dataType.simpleString(), r.schema["__rk"].dataType.simpleString()):
        l, r = l.withColumn("__lk", F.col("__lk").cast("string")), r.withColumn("__rk", F.col("__rk").cast("string"))
    if match_empty_keys:
        l, r = (d.withColumn(k, F.coalesce(F.col(k).cast("string"), F.lit(""))) for d, k in ((l, "__lk"), (r, "__rk")))
    elif l.schema["__lk"].dataType.simpleString() == "string":
        l, r = (d.withColumn(k, F.nullif(F.col(k), F.lit(""))) for d, k in ((l, "__lk"), (r, "__rk")))
    taken = {c.lower() for c in left.columns}
    names = [right_prefix + c if c.lower() in taken else c for c in right.columns]
    r = r.toDF(*names, "__rk")
    both = l.join(r, F.col("__lk") == F.col("__rk"), how)
    out = both.select(*[F.col(f"`{c}`") for c in left.columns], *([] if how in ("left_semi", "left_anti") else [F.col(f"`{c}`") for c in names]))
    return out if fill is None else out.fillna(fill)


def index_pairs(left: DataFrame, right: DataFrame, key: str, row: str) -> DataFrame:
    """(left_idx, right_idx) of rows with equal keys."""
    a = left.select(F.col(key).alias("k"), F.col(row).alias("left_idx"))
    b = right.select(F.col(key).alias("k"), F.col(row).alias("right_idx"))
    return a.join(b, "k").select("left_idx", "right_idx")


def bucket_width(ranges: DataFrame, start: str, end: str) -> int:
    """The mean length of the ranges, as a power of two: cut by it, they are at most two pieces each on average."""
    mean = ranges.agg(F.avg(F.col(end).cast("double") - F.col(start).cast("double") + 1)).first()[0]
    return 1 << max(0, int(mean or 1).bit_length())


def range_join(points: DataFrame, ranges: DataFrame, value: str, start: str, end: str, how: str = "left", width: int | None = None) -> DataFrame:
    """``points`` joined with the range [start, end] that holds ``value``.

    Ranges are cut into buckets of ``width`` values (by default of their mean
    length), so the join is an equi-join on the bucket with the bounds as a
    residual: it scales with both sides and needs no broadcast.
    """
    width = width or bucket_width(ranges, start, end)
    low, high = (F.floor(F.col(c) / F.lit(width)).cast("long") for c in (start, end))
    cut = ranges.withColumn("__b", F.explode(F.sequence(low, high)))
    own = points.withColumn("__p", F.floor(F.col(value) / F.lit(width)).cast("long"))
    on = (F.col("__p") == F.col("__b")) & (F.col(value) >= F.col(start)) & (F.col(value) <= F.col(end))
    return own.join(cut, on, how).drop("__p", "__b")
