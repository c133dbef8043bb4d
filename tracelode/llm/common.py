"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, scratch

__all__ = ["connected_components", "materialize", "prefix", "scratch", "text_key", "text_or_empty"]


def prefix(df: DataFrame) -> str:
    """A start for the names of helper columns that no column of ``df`` has."""
    p = "__tl_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """What stands for a text in joins: its digest; a null text has that of the empty one."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component: the least node.

    Alternating large-star and small-star rounds; each is a partial aggregate
    and a join, so no node's neighbours are gathered in one place.  Every
    round's edges go to the shared folder.  Raises if ``max_rounds`` pass
    without a fixed point, rather than returning a partial answer.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc-edges",
    )
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: neighbours above a node link to the least of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        up = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its lesser neighbours link to the least of them
        up = materialize(up.distinct(), "cc-large")
        low = up.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        down = up.join(low, up.u == low.n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, size = now, now.count()
        now = materialize(down.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "cc-small")
        if now.count() == size and now.join(before, ["u", "v"], "left_anti").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
