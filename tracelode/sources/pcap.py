"""Packet captures: packets, flow keys and summaries.

Captures do not split, so each file is one row of bytes (2 GiB at most) and one
task; its packets are handed on in Arrow batches, and flows are counted exactly
by Spark.  Captures are rotated far below that size; split larger ones.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import canonical_flow, payload_kind
from .files import plain_uri
from .formats import PCAP_MAGICS, PCAPNG_MAGIC

SCHEMA = "file string, packet bigint, ts_sec bigint, ts_nsec bigint, incl_len bigint, orig_len bigint, payload binary"
_FLOW = "struct<src_ip:binary,dst_ip:binary,src_port:int,dst_port:int,protocol:int>"
_BATCH = 4 << 20
_MAPPED = b"\0" * 10 + b"\xff\xff"


def packets(data: bytes | memoryview) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(seconds, nanoseconds, captured length, original length, bytes) of each packet; stops at a truncated one."""
    data = memoryview(data)
    if bytes(data[:4]) == PCAPNG_MAGIC:
        yield from _next_generation(data)
        return
    known = PCAP_MAGICS.get(bytes(data[:4]))
    if known is None:
        return
    order, per_second = known
    head = struct.Struct("<IIII" if order == "little" else ">IIII")
    at = 24
    while at + 16 <= len(data):
        sec, part, incl, orig = head.unpack_from(data, at)
        at += 16
        if at + incl > len(data):
            return
        yield sec, part * (1_000_000_000 // per_second), incl, orig, bytes(data[at : at + incl])
        at += incl


def _next_generation(data: memoryview) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Packets of enhanced and simple packet blocks; every section has its own byte order and clocks."""
    at, e, ticks = 0, "<", []
    while at + 12 <= len(data):
        if bytes(data[at : at + 4]) == PCAPNG_MAGIC:
            e, ticks = "<" if bytes(data[at + 8 : at + 12]) == b"\x4d\x3c\x2b\x1a" else ">", []
        kind, size = struct.unpack_from(e + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == 1:
            ticks.append(_resolution(body[8:], e))
        elif kind == 6 and len(body) >= 20:
            port, high, low, incl, orig = struct.unpack_from(e + "IIIII", body)
            per = ticks[port] if port < len(ticks) else 1_000_000
            sec, part = divmod((high << 32) | low, per)
            yield sec, part * 1_000_000_000 // per, incl, orig, bytes(body[20 : 20 + incl])
        elif kind == 3 and len(body) >= 4:
            (orig,) = struct.unpack_from(e + "I", body)
            yield 0, 0, min(orig, len(body) - 4), orig, bytes(body[4 : 4 + orig])
        at += size


def _resolution(options: memoryview, e: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(e + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            v = options[at + 4]
            return 1 << (v & 0x7F) if v & 0x80 else 10**v
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def flow_key(frame: bytes) -> tuple[bytes, bytes, int, int, int] | None:
    """(source, destination, source port, destination port, protocol) of an Ethernet frame; v4 is mapped into v6."""
    if len(frame) < 14:
        return None
    kind, at = int.from_bytes(frame[12:14]), 14
    if kind == 0x8100 and len(frame) >= 18:
        kind, at = int.from_bytes(frame[16:18]), 18
    if kind == 0x0800 and len(frame) >= at + 20:
        size = (frame[at] & 15) * 4
        protocol = frame[at + 9]
        src, dst = _MAPPED + frame[at + 12 : at + 16], _MAPPED + frame[at + 16 : at + 20]
        at += size
    elif kind == 0x86DD and len(frame) >= at + 40:
        protocol = frame[at + 6]
        src, dst = frame[at + 8 : at + 24], frame[at + 24 : at + 40]
        at += 40
    else:
        return None
    ports = (0, 0)
    if protocol in (6, 17) and len(frame) >= at + 4:
        ports = int.from_bytes(frame[at : at + 2]), int.from_bytes(frame[at + 2 : at + 4])
    return src, dst, *ports, protocol


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("packet", "ts_sec", "ts_nsec", "incl_len", "orig_len")], ("payload", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1])
        if size > _BATCH:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_packets(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per packet of the captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _batches((path, k, *p) for k, p in enumerate(packets(content.as_buffer())))

    return spark.read.format("binaryFile").load(paths).select(plain_uri(F.col("path")), "content").mapInArrow(run, SCHEMA)


def with_flows(df: DataFrame) -> DataFrame:
    """Adds flow (both ways of a conversation alike) and payload_kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
        kind = pa.struct([("src_ip", pa.binary()), ("dst_ip", pa.binary()), *[(n, pa.int32()) for n in names[2:]]])
        for b in batches:
            keys = [flow_key(p.as_py()) for p in b.column("payload")]
            flows = pa.array([None if k is None else dict(zip(names, k, strict=True)) for k in keys], kind)
            yield pa.record_batch([*b.columns, flows], [*b.schema.names, "_f"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", _f {_FLOW}"
    flow = canonical_flow(F.col("_f.src_ip"), F.col("_f.src_port"), F.col("_f.dst_ip"), F.col("_f.dst_port"), F.col("_f.protocol"))
    return df.mapInArrow(run, schema).select(
        *df.columns, F.when(F.col("_f").isNotNull(), flow).alias("flow"), payload_kind(F.col("payload")).alias("payload_kind")
    )


def summarise(df: DataFrame) -> DataFrame:
    """(packets, bytes, flows, tcp, udp, suspicious) in one row; flows are exact."""
    return with_flows(df).agg(
        F.count("*").alias("packets"),
        F.coalesce(F.sum("orig_len"), F.lit(0)).alias("bytes"),
        F.count_distinct("flow").alias("flows"),
        F.count_if(F.col("flow.protocol") == 6).alias("tcp"),
        F.count_if(F.col("flow.protocol") == 17).alias("udp"),
        F.count_if(F.col("payload_kind").isNotNull()).alias("suspicious"),
    )
