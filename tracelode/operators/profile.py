"""Column profiles: one aggregate over the rows, one output row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import number, strict_number

LEVELS = ("basic", "discovery", "full")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Values up to which a standard deviation is none.
FLAT = 1e-10


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and (columns is None or c in columns)]


def _cells(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., column, v, s): every cell in long form; v the number, s the text of a cell without one, both null if blank."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        col, kind = F.col(f"`{c}`"), kinds[c]
        if c in numeric_columns(df):
            v, s = col.cast("double"), F.lit(None).cast("string")
        else:
            text = F.trim(col.cast("string"))
            blank = text.isNull() | text.isin("", '""')
            v = F.when(~blank, strict_number(text)) if kind == "string" else F.lit(None).cast("double")
            s = F.when(~blank & v.isNull(), text)
        parts.append(F.struct(F.lit(c).alias("column"), v.alias("v"), s.alias("s")))
    return df.select(*extra, F.explode(F.array(*parts)).alias("_c")).select(*extra, "_c.column", "_c.v", "_c.s")


def _moments(v: Column) -> list[Column]:
    """Count, moments and range; sample variance, adjusted skewness and excess kurtosis."""
    n = F.count(v).cast("double")
    g1, g2 = F.skewness(v), F.kurtosis(v)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    zero = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return [
        F.count(v).alias("count"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev"),
        zero(skew).alias("skewness"),
        zero(kurt).alias("kurtosis"),
    ]


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per numeric column (and group of ``by``): moments, range, nulls, filling ratio, health.

    A single pass without an exploded row: every column is aggregated beside
    the others, and the one wide row is turned at the end.
    """
    picked = numeric_columns(df, columns)
    wide = df.groupBy(*by).agg(
        *[F.struct(*_moments(F.col(f"`{c}`").cast("double")), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("null_count")).alias(f"_{k}") for k, c in enumerate(picked)]
    )
    long = wide.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{k}").alias("p")) for k, c in enumerate(picked)])).alias("x")
    ).select(*by, "x.column", "x.p.*")
    return with_health(long.withColumn("is_categorical", F.lit(False))).drop("is_categorical")


def with_health(profile: DataFrame) -> DataFrame:
    """Adds filling_ratio, is_constant, health_score and warnings."""
    n, nulls = F.col("count"), F.col("null_count")
    fill = F.when(n + nulls == 0, 1.0).otherwise(n / (n + nulls))
    flat = (n > 1) & (F.col("std_dev") < FLAT)
    number_like = ~F.col("is_categorical")
    skewed = number_like & (F.abs("skewness") > 3)
    score = (
        F.lit(100.0)
        - F.when(number_like & flat, 20.0).otherwise(0.0)
        - F.when(skewed, 10.0).otherwise(0.0)
        - F.when(fill < 0.5, 30.0).otherwise(0.0)
    )
    warnings = F.array_compact(
        F.array(
            F.when(number_like & flat, F.lit("constant")),
            F.when(skewed, F.lit("skewed")),
            F.when(fill < 0.5, F.lit("sparse")),
        )
    )
    return profile.withColumns(
        {
            "filling_ratio": fill,
            "is_constant": flat,
            "health_score": F.greatest(F.lit(0.0), score),
            "warnings": F.array_join(warnings, ","),
        }
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, level: str = "discovery", by: Sequence[str] = (), limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The full profile of any columns, text included; one row per column (and group of ``by``).

    basic: counts, moments and nulls.  discovery: also distinct values, ratios,
    text size and the ten most frequent values.  full: also quartiles and the
    share outside ``limits`` (bounds by column).
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    picked = [c for c in df.columns if c not in by and (columns is None or c in columns)]
    cells = _cells(df, picked, by)
    keys = [*by, "column"]
    blank = F.col("v").isNull() & F.col("s").isNull()
    some = F.count(F.when(~blank, 1))
    aggs = [
        *_moments(F.col("v"))[1:],
        some.alias("count"),
        F.count("v").alias("numeric_count"),
        F.count(F.when(blank, 1)).alias("null_count"),
        (F.count("s") > 0).alias("is_categorical"),
        (F.coalesce(F.sum(F.octet_length("s")), F.lit(0)) / F.lit(1024.0)).alias("text_kb"),
    ]
    if level == "full":
        # a sketch of bounded size: ranks are within a ten-thousandth
        aggs.append(F.percentile_approx("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias("quartiles"))
        bounds = F.lit(False)
        for c, (low, high) in (limits or {}).items():
            bounds = bounds | ((F.col("column") == c) & ((F.col("v") < low) | (F.col("v") > high)))
        aggs.append(F.coalesce(F.sum(bounds.cast("long")), F.lit(0)).alias("out_of_range"))
    out = cells.groupBy(*keys).agg(*aggs)
    if level != "basic":
        tops = top_values(cells.where("s IS NOT NULL"), keys)
        out = out.join(tops, keys, "left").withColumns(
            {"distinct_count": F.coalesce("distinct_count", F.lit(0).cast("long")), "unique_ratio": F.coalesce(F.try_divide("distinct_count", "count"), F.lit(0.0))}
        )
    return with_health(out)


def top_values(cells: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """(keys..., distinct_count, top_values): the ``n`` most frequent texts, ties by text.

    Values are counted first, so the ranking sees each distinct value once.
    """
    counted = cells.groupBy(*keys, F.col("s").alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "value"))
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("distinct_count"))
    best = counted.withColumn("_r", place).where(F.col("_r") <= n).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_r", "value", F.col("n").alias("count")))).alias("_t")
    )
    return sizes.join(best, list(keys)).select(
        *keys, "distinct_count", F.transform("_t", lambda x: F.struct(x["value"], x["count"])).alias("top_values")
    )


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, count) of the most frequent values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def quartiles(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """(q1, median, q3); exact, interpolated between neighbours, unless ``approximate``.

    The exact ones take two passes: a sketch brackets each rank, then only the
    values in the brackets are counted and ranked.
    """
    qs = (0.25, 0.5, 0.75)
    rows = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    if approximate:
        found = rows.agg(F.percentile_approx("v", F.array(*map(F.lit, qs)), 10_000).alias("q"))
        return found.select(*[F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))])
    wide = F.array(*[F.lit(min(1.0, max(0.0, q + d))) for q in qs for d in (-_SLACK, _SLACK)])
    n, sketch = rows.agg(F.count("*"), F.percentile_approx("v", wide, 10_000)).first()
    if n <= _FEW:  # a bracket might miss a neighbour
        found = rows.agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q"))
        return found.select(*[F.col("q")[k].alias(name) for k, name in enumerate(("q1", "median", "q3"))])
    brackets = [(sketch[2 * k], sketch[2 * k + 1]) for k in range(len(qs))]
    below = rows.agg(*[F.count_if(F.col("v") < low) for low, _ in brackets]).first()
    inside = F.lit(False)
    for low, high in brackets:
        inside = inside | F.col("v").between(low, high)
    # the brackets hold some thousandths of the rows, and each value once
    counted = rows.where(inside).groupBy("v").agg(F.count("*").alias("n"))
    exprs = []
    for k, (q, (low, high)) in enumerate(zip(qs, brackets, strict=True)):
        place = q * (n - 1)
        run = F.sum(F.when(F.col("v").between(low, high), F.col("n")).otherwise(0)).over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        counted = counted.withColumn(f"r{k}", run)
        at = lambda rank, k=k, low=low, high=high: F.min(F.when(F.col("v").between(low, high) & (F.col(f"r{k}") > rank - below[k]), F.col("v")))
        first, second = at(int(place)), at(min(n - 1, int(place) + 1))
        exprs.append((first + (second - first) * F.lit(place - int(place))).alias(("q1", "median", "q3")[k]))
    return counted.agg(*exprs)


#: Ranks on either side of a quartile that its bracket spans, as a share; ten times the sketch's error.
_SLACK = 0.001
#: Values that are sorted at once.
_FEW = 10_000


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """(bin, count) over ``bins`` equal widths of [low, high]; the top edge is in the last; empty bins are left out."""
    v = F.col(column).cast("double")
    k = F.least(F.floor((v - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(v.between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("count"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, value) for every pair of columns, in one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_{k}").alias("value")) for k, (a, b) in enumerate(pairs)])).alias("x")
    ).select("x.*")


def monotonic(df: DataFrame, column: str, order: str) -> DataFrame:
    """(increasing, decreasing): whether the values never fall, or never rise, along ``order``.

    The order is cut into ranges; within each the sorted values are compared by
    a window, and the ranges' first and last values are compared after.
    """
    rows = df.select(F.col(order).alias("o"), F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    parts = rows.repartitionByRange("o").withColumn("p", F.spark_partition_id())
    before = F.lag("v").over(W.partitionBy("p").orderBy("o"))
    edges = parts.withColumn("b", before).groupBy("p").agg(
        F.coalesce(F.bool_and(F.col("v") >= F.col("b")), F.lit(True)).alias("up"),
        F.coalesce(F.bool_and(F.col("v") <= F.col("b")), F.lit(True)).alias("down"),
        F.min_by("v", "o").alias("first"),
        F.max_by("v", "o").alias("last"),
    )
    # one row per range: small by construction
    linked = edges.withColumn("b", F.lag("last").over(W.orderBy("p")))
    return linked.agg(
        F.bool_and(F.col("up") & (F.col("b").isNull() | (F.col("first") >= F.col("b")))).alias("increasing"),
        F.bool_and(F.col("down") & (F.col("b").isNull() | (F.col("first") <= F.col("b")))).alias("decreasing"),
    )


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows over the union of columns, names compared trimmed and without case."""
    spelled: dict[str, str] = {}
    out = None
    for df in frames:
        names = [spelled.setdefault(c.strip().lower(), c.strip()) for c in df.columns]
        df = df.toDF(*names)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def number_column(df: DataFrame, column: str) -> Column:
    return number(dict(df.dtypes)[column], F.col(f"`{column}`"))
