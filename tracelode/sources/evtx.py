"""Windows event logs: record scan, carving and level summary.

Chunks are 64 KiB and independent.  A file is one row of bytes (2 GiB at most);
its chunks are exploded by Spark before decoding, so the decoding of one file
is spread.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import filetime_seconds
from .files import plain_uri
from .formats import EVTX_MAGIC

HEADER, CHUNK, FIRST = 4096, 65_536, 512
MARK = b"\x2a\x2a\x00\x00"
LEAST, MOST = 24, 1 << 20
SCHEMA = "file string, offset bigint, record_id decimal(20,0), filetime decimal(20,0), event_id int, level int, task int"


def find_all(data: bytes, mark: bytes) -> list[int]:
    """All offsets of ``mark``, overlapping ones included."""
    out, at = [], data.find(mark)
    while at >= 0:
        out.append(at)
        at = data.find(mark, at + 1)
    return out


def _token(payload: bytes, mark: bytes, size: int) -> int | None:
    at = payload.find(mark)
    value = payload[at + 2 : at + 2 + size] if at >= 0 else b""
    return int.from_bytes(value, "little") if len(value) == size else None


def record(rec: bytes) -> tuple[int, int, int | None, int, int | None]:
    """(record id, file time, event id, level, task) of one record."""
    number, filetime = struct.unpack_from("<QQ", rec, 8)
    payload = rec[24:]
    event = _token(payload, b"\x05\x04", 2)
    level = _token(payload, b"\x05\x01", 1)
    return number, filetime, event, 4 if level is None else level, event


def chunk_records(chunk: bytes, base: int = 0) -> Iterator[tuple]:
    """(offset, record...) of the records of one chunk; sizes out of bounds are stepped over."""
    at = min(FIRST, len(chunk))
    while (at := chunk.find(MARK, at)) >= 0 and at + LEAST <= len(chunk):
        (size,) = struct.unpack_from("<I", chunk, at + 4)
        if LEAST <= size <= MOST and at + size <= len(chunk):
            yield base + at, *record(chunk[at : at + size])
            at += size
        else:
            at += len(MARK)


def chunk_starts(data: bytes, carve: bool = False) -> list[int]:
    """Where chunks start: every 64 KiB after the header, or wherever a chunk's mark is found."""
    if data.startswith(EVTX_MAGIC) and not carve:
        return list(range(HEADER, len(data), CHUNK))
    return find_all(data, b"ElfC")


def scan(data: bytes, carve: bool = False) -> Iterator[tuple]:
    for at in chunk_starts(data, carve):
        yield from chunk_records(data[at : at + CHUNK], at)


def read_records(spark: SparkSession, paths: list[str] | str, carve: bool = False) -> DataFrame:
    """One row per record; files without the header are carved."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                for at in chunk_starts(data, carve):
                    yield pa.record_batch([pa.array([path]), pa.array([at], pa.int64()), pa.array([data[at : at + CHUNK]])], ["file", "at", "chunk"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.decimal128(20, 0), pa.decimal128(20, 0), pa.int32(), pa.int32(), pa.int32()]
        names = ["file", "offset", "record_id", "filetime", "event_id", "level", "task"]
        for b in batches:
            rows = [(f, *r) for f, at, c in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in chunk_records(c, at)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    chunks = spark.read.format("binaryFile").load(paths).select(plain_uri(F.col("path")), "content").mapInArrow(split, "file string, at bigint, chunk binary")
    records = chunks.repartition("file", "at").mapInArrow(decode, SCHEMA)
    return records.withColumn("unix_seconds", filetime_seconds(F.col("filetime")))


def summarise(records: DataFrame) -> DataFrame:
    """(total, errors, warnings, info): levels 1 and 2, level 3, the rest."""
    level = F.col("level")
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(level.isin(1, 2)).alias("errors"),
        F.count_if(level == 3).alias("warnings"),
        F.count_if(~level.isin(1, 2, 3)).alias("info"),
    )


def carve_signature(df: DataFrame, content: str, mark: bytes, keep: list[str]) -> DataFrame:
    """(keep..., offset): where a signature lies in binary content, overlapping ones included."""
    hit = F.contains(F.col(content), F.lit(bytearray(mark)))
    rows = df.where(hit).select(*keep, F.col(content).alias("__data"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_all(d.as_py(), mark) for d in b.column("__data")]
            owner = pa.array([k for k, at in enumerate(found) for _ in at], pa.int64())
            taken = b.drop_columns(["__data"]).take(owner)
            yield pa.record_batch([*taken.columns, pa.array([x for at in found for x in at], pa.int64())], [*taken.schema.names, "offset"])

    return rows.mapInArrow(run, schema)
