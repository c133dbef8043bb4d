"""File listing through Hadoop's file systems, pruned discovery and the file finder.

Listing runs on the driver (names and sizes only), so it reaches every store
that Spark reads; contents are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that discovery passes over, and the finder's type words.
PRUNED = frozenset("node_modules target dist build vendor".split())
TYPES = {
    "doc": "pdf doc docx xls xlsx ppt pptx txt rtf odt csv",
    "vid": "mp4 mkv avi mov wmv flv webm",
    "aud": "mp3 wav flac ogg m4a",
    "img": "jpg jpeg png gif bmp svg webp",
    "code": "rs ts js py c cpp h go java cs html css",
}
_LONG = {"document": "doc", "video": "vid", "audio": "aud", "image": "img"}


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    is_dir: bool

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]

    @property
    def extension(self) -> str:
        return self.name.rsplit(".", 1)[-1].lower() if "." in self.name.lstrip(".") else ""


def plain_uri(path: Column) -> Column:
    """A file's path in one spelling; Spark writes local ones with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def walk(spark: SparkSession, base: str, full_scan: bool = False) -> Iterator[Entry]:
    """Everything below ``base`` in name order; what cannot be listed is passed over."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(base)
    status = fs.getFileStatus(root)
    if not status.isDirectory():
        yield Entry(status.getPath().toString(), status.getLen(), False)
        return
    todo = [root]
    while todo:
        try:
            found = sorted(fs.listStatus(todo.pop()), key=lambda s: s.getPath().getName())
        except Exception:  # noqa: BLE001  a folder without permission
            continue
        below = []
        for s in found:
            name = s.getPath().getName()
            if s.isDirectory():
                if full_scan or not (name.startswith(".") or name in PRUNED):
                    yield Entry(s.getPath().toString(), 0, True)
                    below.append(s.getPath())
            else:
                yield Entry(s.getPath().toString(), s.getLen(), False)
        todo += below[::-1]


def data_files(spark: SparkSession, base: str, full_scan: bool = False) -> list[str]:
    return [e.path for e in walk(spark, base, full_scan) if not e.is_dir]


def find_files(
    spark: SparkSession, base: str, query: str, case_sensitive: bool = False, dirs_only: bool = False, files_only: bool = False, limit: int | None = None
) -> DataFrame:
    """(path, size, is_dir) of entries that meet a query.

    ``type:word`` and ``.ext`` name extensions (directories then never match);
    the other words, joined by a blank, are a part of the name.
    """
    extensions: set[str] = set()
    words = []
    for part in query.split():
        low = part.lower()
        kind = low.removeprefix("type:")
        if low.startswith("type:") and (kind := _LONG.get(kind, kind)) in TYPES:
            extensions.update(TYPES[kind].split())
        elif low.startswith(".") and len(low) > 1 and "." not in low[1:]:
            extensions.add(low[1:])
        else:
            words.append(part)
    entries = [(e.path, e.size, e.is_dir, e.name, e.extension) for e in walk(spark, base, full_scan=True)]
    df = spark.createDataFrame(entries, "path string, size bigint, is_dir boolean, name string, extension string")
    if extensions:
        df = df.where(~F.col("is_dir") & F.col("extension").isin(*sorted(extensions)))
    if words:
        part = " ".join(words)
        df = df.where(F.contains("name", F.lit(part)) if case_sensitive else F.contains(F.lower("name"), F.lit(part.lower())))
    if dirs_only:
        df = df.where("is_dir")
    if files_only:
        df = df.where("NOT is_dir")
    df = df.select("path", "size", "is_dir").orderBy("path")
    return df if limit is None else df.limit(limit)
