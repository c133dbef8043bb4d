"""Row-level edits: deletions and replacements laid over a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


@dataclass
class Delta:
    """Edits of a table by row number; each edit returns a new Delta.

    ``deletes`` has the ``keys`` (``row_idx``, or ``file`` and ``row_idx``);
    ``updates`` has them and ``content`` (a struct, or the line of a text
    table).  A row is in one of them at most.
    """

    deletes: DataFrame
    updates: DataFrame
    keys: tuple[str, ...] = ("row_idx",)

    @classmethod
    def empty(cls, spark: SparkSession, content: str = "string", by_file: bool = False) -> Delta:
        keys = ("file", "row_idx") if by_file else ("row_idx",)
        ddl = "file string, row_idx bigint" if by_file else "row_idx bigint"
        return cls(_empty(spark, ddl), _empty(spark, f"{ddl}, content {content}"), keys)

    def delete(self, rows: DataFrame) -> Delta:
        """Tombstones for rows; a pending replacement goes."""
        on = list(self.keys)
        return Delta(self.deletes.unionByName(rows.select(*on)).distinct(), self.updates.join(rows, on, "left_anti"), self.keys)

    def update(self, rows: DataFrame) -> Delta:
        """Replacements (keys, ``content``); a deleted row comes back."""
        on = list(self.keys)
        newer = self.updates.join(rows, on, "left_anti").unionByName(rows.select(*on, "content"))
        return Delta(self.deletes.join(rows, on, "left_anti"), newer, self.keys)

    def state(self) -> DataFrame:
        """(keys, is_deleted, content)."""
        kind = self.updates.schema["content"].dataType
        gone = self.deletes.select(*self.keys, F.lit(True).alias("is_deleted"), F.lit(None).cast(kind).alias("content"))
        return gone.unionByName(self.updates.select(*self.keys, F.lit(False).alias("is_deleted"), "content"))

    def save(self, path: str) -> str:
        """Write both tables as a new version under ``path``; earlier versions stay, so readers and plans keep what they read."""
        spark = self.deletes.sparkSession
        target = f"{path}/version={max(_versions(spark, path), default=0) + 1:08d}"
        self.state().write.mode("errorifexists").parquet(target)
        return target

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Delta:
        """The last whole version under ``path``."""
        have = _versions(spark, path)
        if not have:
            raise FileNotFoundError(path)
        rows = spark.read.parquet(f"{path}/version={max(have):08d}")
        keys = tuple(c for c in ("file", "row_idx") if c in rows.columns)
        return cls(rows.where("is_deleted").select(*keys), rows.where("NOT is_deleted").select(*keys, "content"), keys)


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    whole = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return [int(n.removeprefix("version=")) for n in whole if n.startswith("version=")]


def overlay(df: DataFrame, delta: Delta, row_col: str = "row_idx", line_col: str | None = None) -> DataFrame:
    """``df`` with deleted rows gone and replaced rows substituted.

    ``content`` replaces ``line_col``, or if it is a struct the columns that it
    names.  ``row_col`` holds the row number; with edits by file, ``file`` the file.
    """
    own = [row_col if k == "row_idx" else k for k in delta.keys]
    gone = delta.deletes.toDF(*[f"__gone_{k}" for k in delta.deletes.columns])
    new = delta.updates.select(*[F.col(k).alias(f"__row_{k}") for k in delta.keys], F.col("content").alias("__new"), F.lit(True).alias("__has"))

    def on(mark: str):
        out = F.lit(True)
        for mine, k in zip(own, delta.keys, strict=True):
            out = out & (F.col(f"`{mine}`") == F.col(f"__{mark}_{k}"))
        return out

    both = df.join(gone, on("gone"), "left_anti").join(new, on("row"), "left")
    if line_col:
        replaced = {line_col: "__new"}
    else:
        replaced = {f.name: f"__new.`{f.name}`" for f in delta.updates.schema["content"].dataType.fields}
    return both.select(
        *[F.when(F.col("__has"), F.col(replaced[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in replaced else F.col(f"`{c}`") for c in df.columns]
    )


def compact(df: DataFrame, delta: Delta, path: str, row_col: str = "row_idx", line_col: str | None = None) -> None:
    """Write the edited table to a new place."""
    overlay(df, delta, row_col, line_col).write.mode("errorifexists").parquet(path)
