"""Opening files and directory trees as DataFrames, and fetching row ranges."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import strict_number, unquote
from ..operators.profile import union_columns
from ..options import ReadOptions
from ..scratch import materialize
from . import formats
from .files import data_files, plain_uri


def head_of(spark: SparkSession, path: str, size: int = 8192) -> bytes:
    """The first bytes of a file, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    raw = p.getFileSystem(conf).open(p)
    kind = formats.compression(path)
    codec = None if kind in WHOLE else jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    try:
        stream = codec.createInputStream(raw) if codec is not None else raw
        data = jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size))
    finally:
        raw.close()
    out = bytes(data)
    if kind == "xz":
        out = lzma.LZMADecompressor().decompress(out, size)
    elif kind == "zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().decompressobj().decompress(out)[:size]
    return out


def uri_of(spark: SparkSession, path: str) -> str:
    """A path as the ``file`` column spells it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(p).toUri().toString()
    return "file:///" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def text_lines(spark: SparkSession, paths: list[str] | str, skip_rows: int = 0, encoding: str = "utf-8") -> DataFrame:
    """(file, row_idx, line) of every line, numbered from 0 within its file after ``skip_rows`` lines.

    Lines of a block are numbered within the block; a small count for each
    block gives the base.  xz and zst files are read whole, one task each.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    whole = [p for p in paths if formats.compression(p) in WHOLE]
    rest = [p for p in paths if p not in whole]
    parts = []
    if rest:
        parts.append(in_file_order(spark.read.text(rest)).select("file", "row_idx", F.col("value").alias("line")))
    if whole:
        parts.append(_whole_lines(spark, whole, encoding))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumn("line", F.when(F.col("row_idx") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.regexp_replace("line", "\r$", "")))
    return out.where(F.col("row_idx") >= skip_rows).withColumn("row_idx", F.col("row_idx") - skip_rows) if skip_rows else out


#: Compressions that Spark's text reader has no codec for everywhere.
WHOLE = ("xz", "zstd")


def unpack(data: bytes, kind: str) -> bytes:
    if kind == "xz":
        return lzma.decompress(data)
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as stream:
        return stream.read()


def _whole_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = unpack(content.as_py(), formats.compression(path)).decode(encoding, "replace")
                lines = text.removesuffix("\n").split("\n") if text else []
                yield pa.record_batch([pa.array([path] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["file", "row_idx", "line"])

    return spark.read.format("binaryFile").load(paths).select(plain_uri(F.col("path")), "content").mapInArrow(run, "file string, row_idx bigint, line string")


def _csv(spark: SparkSession, paths: list[str], o: ReadOptions, head: bytes, numbered: bool) -> DataFrame:
    lines_of_head = head.split(b"\n", o.skip_rows)[-1] if o.skip_rows else head
    sep = o.delimiter or formats.delimiter(lines_of_head) or ","
    quote = o.rfc_4180 if o.rfc_4180 is not None else formats.quoted(head)
    marks = {"quote": '"', "escape": '"'} if quote else {"quote": "\u0000"}
    reader = spark.read.options(sep=sep, header=o.has_header, mode="PERMISSIVE", enforceSchema=False, **marks)
    if quote:
        reader = reader.option("multiLine", o.multi_line)
    if any(formats.compression(p) in WHOLE for p in paths) or o.skip_rows:
        # text first: a preamble is cut, and what Spark cannot unpack unpacked, before any parsing
        lines = text_lines(spark, paths, o.skip_rows)
        first = lines.where("row_idx = 0").orderBy("file").select("line").first()
        if first is None:
            return spark.createDataFrame([], T.StructType([]))
        schema = reader.csv(spark.sparkContext.parallelize([first.line], 1)).schema
        rows = lines.where("row_idx > 0").withColumn("row_idx", F.col("row_idx") - 1) if o.has_header else lines
        names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        kept = ["file", "row_idx"] if numbered else []
        out = rows.select(F.from_csv("line", _ddl(names), {"sep": sep, "mode": "PERMISSIVE", **marks}).alias("__r"), *kept).select("__r.*", *kept)
    else:
        out = reader.csv(paths)
        out = in_file_order(out) if numbered else out
    return _cells(out, o)


def _cells(df: DataFrame, o: ReadOptions) -> DataFrame:
    """Cells as the options ask: without outer quotes, as the types that their first values spell."""
    own = [c for c in df.columns if c not in ("file", "row_idx")]
    if o.strip_quotes:
        df = df.withColumns({c: unquote(F.col(f"`{c}`")) for c in own if dict(df.dtypes)[c] == "string"})
    return typed(df, infer_types(df.select(*[f"`{c}`" for c in own]))) if o.infer else df


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` string" for f in schema)


def read_files(spark: SparkSession, paths: list[str], options: ReadOptions | None = None, numbered: bool = False) -> DataFrame:
    """One DataFrame over files of any mix of formats, columns united by name.

    Row formats give text cells (csv, text; typed with ``options.infer``) or the
    parser's types (json, parquet).  ``numbered`` adds ``file`` and ``row_idx``.
    """
    o = options or ReadOptions()
    heads = {p: head_of(spark, p) for p in sorted(paths)}
    by_format: dict[str, list[str]] = {}
    for p, head in heads.items():
        by_format.setdefault(formats.detect(head, p, o.forced_format), []).append(p)
    frames = []
    place = in_file_order if numbered else (lambda df: df)
    for kind, group in sorted(by_format.items()):
        if kind in formats.REGISTERED:
            frames.append(formats.REGISTERED[kind].read(spark, group))
        elif kind == "csv":
            # files with other headers are read apart, as one reader takes one header
            same: dict[bytes, list[str]] = {}
            for p in group:
                same.setdefault(heads[p].splitlines()[:1][0] if o.has_header and not o.skip_rows and heads[p] else b"", []).append(p)
            frames += [_csv(spark, g, o, heads[g[0]], numbered) for g in same.values()]
        elif kind == "json":
            frames.append(place(spark.read.json(group)))
        elif kind == "parquet":
            frames.append(place(spark.read.parquet(*group)))
        elif kind == "pcap":
            from .pcap import read_packets

            packets = read_packets(spark, group)
            frames.append(packets.withColumn("row_idx", F.col("packet")) if numbered else packets)
        elif kind == "evtx":
            from .evtx import read_records

            records = read_records(spark, group)
            frames.append(records.withColumn("row_idx", F.row_number().over(W.partitionBy("file").orderBy("offset")).cast("long") - 1) if numbered else records)
        else:
            lines = text_lines(spark, group).withColumn("line", F.trim("line"))
            frames.append(lines.select("line", "file", "row_idx") if numbered else lines.select("line"))
    return frames[0] if len(frames) == 1 else union_columns(frames)


def open_dataset(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """A file, or a directory tree without hidden and build folders (all of it with ``full_scan``)."""
    o = options or ReadOptions()
    return read_files(spark, data_files(spark, path, o.full_scan), o)


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """Top-level values of JSON text as text columns, nested ones serialised."""
    return df.select("*", F.from_json(column, "map<string,string>").alias("fields"))


#: Bits of a monotonically increasing id that count the rows of a partition.
_ROW_BITS = 33


def with_row_idx(df: DataFrame, order: str) -> DataFrame:
    """Rows numbered from 0 along ``order``, without gaps.

    The order is cut into ranges, which are sorted and written once, each row
    with its range and its place in it; counts of the ranges give each its
    base.  So the whole table never passes through one task, and what is
    numbered is what was written.  Rows of equal ``order`` are in any order.
    """
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id())
    return _with_bases(materialize(parts, "row-numbers"))


def _with_bases(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_idx`` out of ``__id``: the partition's number above the row's place in it."""
    part = F.shiftright("__id", _ROW_BITS)
    sizes = rows.groupBy(part.alias("__q")).agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(W.orderBy("__q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__q", base.alias("__base"))  # one row per range
    numbered = rows.join(F.broadcast(bases), part == F.col("__q"))
    row = (F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("__base")).cast("long")
    return numbered.withColumn("row_idx", row).drop("__id", "__q", "__base")


def in_file_order(rows: DataFrame) -> DataFrame:
    """``rows`` as read from files, with ``file`` and ``row_idx`` from 0 within each file.

    Rows of a block are numbered within the block; a small count for each block
    gives the base.  ``rows`` has to come from a file source, untouched.
    """
    own = rows.select("*", plain_uri(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    # ids rise within a block; its first id and its size give the rank of each row
    blocks = own.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(W.partitionBy("file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("file").alias("__bf"), F.col("__block").alias("__bb"), "__first", base.alias("__base"))
    numbered = own.join(blocks, (F.col("file") == F.col("__bf")) & (F.col("__block") == F.col("__bb")))
    row = (F.col("__base") + F.col("__id") - F.col("__first")).alias("row_idx")
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], "file", row)


def rows_between(df: DataFrame, start: int, end: int, row_col: str = "row_idx") -> DataFrame:
    """Rows of the half-open range [start, end), in order."""
    return df.where((F.col(row_col) >= start) & (F.col(row_col) < end)).orderBy(row_col)


def view(df: DataFrame, start: int = 0, count: int = 20, row_col: str = "row_idx") -> DataFrame:
    return rows_between(df, start, start + count, row_col)


def metadata(spark: SparkSession, paths: list[str], rows: DataFrame) -> DataFrame:
    """(files, total_rows, total_mib, columns) in one row."""
    size = spark.read.format("binaryFile").load(paths).select("path", "length").agg(F.count("*").alias("files"), (F.sum("length") / F.lit(1024.0 * 1024)).alias("total_mib"))
    return size.crossJoin(rows.agg(F.count("*").alias("total_rows"))).withColumn("columns", F.array(*[F.lit(c) for c in rows.columns]))


def infer_types(df: DataFrame, sample: int = 50) -> dict[str, str]:
    """number, currency, boolean, date or string for each column, from its first values."""
    rules = [
        ("boolean", r"(?i)^(true|false|yes|no|0|1)$"),
        ("number", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        ("currency", r"^[$€£¥]\s?[+-]?[\d,]+(\.\d+)?$"),
        ("date", r"^\d{4}-\d{2}-\d{2}"),
    ]
    head = df.limit(sample).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    fits = head.agg(*[F.coalesce(F.bool_and(F.trim(F.col(f"`{c}`")).rlike(r)), F.lit(False)).alias(f"{k}_{name}") for k, c in enumerate(df.columns) for name, r in rules]).first()
    return {c: next((name for name, _ in rules if fits[f"{k}_{name}"]), "string") for k, c in enumerate(df.columns)}


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text cells as the kinds of ``infer_types``; a cell that does not fit its column's kind is null."""
    how = {
        "number": strict_number,
        "currency": lambda c: F.regexp_replace(c, r"[$€£¥,\s]", "").try_cast("double"),
        "boolean": lambda c: F.lower(F.trim(c)).isin("true", "yes", "1"),
        "date": lambda c: F.substring(F.trim(c), 1, 10).try_cast("date"),
    }
    out = {}
    for name, kind in kinds.items():
        if kind in how:
            cell = F.col(f"`{name}`").cast("string")
            out[name] = F.when(F.trim(cell) != "", how[kind](cell))
    return df.withColumns(out) if out else df
