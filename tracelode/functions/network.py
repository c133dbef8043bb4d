"""Expressions over flow keys and packet payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payload signatures in order of precedence (latin-1 text).
SIGNATURES = (
    ("PE Executable", "MZ"),
    ("ZIP/Office", "PK\x03\x04"),
    ("PDF Document", "%PDF"),
    ("ELF Binary", "\x7fELF"),
    ("PNG Image", "\x89PNG"),
)


def canonical_flow(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    """One struct for both directions of a flow: the lesser end comes first."""
    a = F.struct(src_ip.alias("ip"), src_port.alias("port"))
    b = F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), protocol.alias("protocol"))


def flow_hash(flow: Column) -> Column:
    return F.xxhash64(flow)


def payload_kind(payload: Column) -> Column:
    """The kind of file that a payload starts with, or holds in its first 256 bytes; null if none.

    A signature earlier in the list wins over one earlier in the payload.
    """
    text = F.decode(F.substring(payload, 1, 256), "ISO-8859-1")
    out = F.lit(None).cast("string")
    for name, mark in reversed(SIGNATURES):
        out = F.when(F.instr(text, mark) > 0, F.lit(name)).otherwise(out)
    for name, mark in reversed(SIGNATURES):
        out = F.when(F.startswith(text, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def filetime_seconds(ft: Column) -> Column:
    """Seconds since 1970 of a count of 100 ns since 1601; not below 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor(ft / F.lit(10_000_000)).cast("bigint") - 11_644_473_600)


def filetime_timestamp(ft: Column) -> Column:
    return F.timestamp_seconds(filetime_seconds(ft))
