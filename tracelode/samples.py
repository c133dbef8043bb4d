"""Small files of every format, made from rules, for queries and tests over sources."""

from __future__ import annotations

import gzip
import lzma
import struct

EVENT_TIME = 133_500_000_000_000_000  # FILETIME of 2024-01-17 21:20:00 UTC


def event_log(chunks: int = 3, records: int = 20, level: int | None = None) -> bytes:
    """An event log: records of 128 bytes with event 1000; the first has no time; ``level`` if given."""
    out = [b"ElfFile\0".ljust(4096, b"\0")]
    for c in range(chunks):
        chunk = bytearray(65_536)
        chunk[:8] = b"ElfChnk\0"
        struct.pack_into("<Q", chunk, 8, c * records + 1)
        for i in range(records):
            at, first = 512 + 128 * i, c == 0 and i == 0
            struct.pack_into("<IIQQ", chunk, at, 0x2A2A, 128, c * records + i + 1, 0 if first else EVENT_TIME + i * 10_000_000)
            chunk[at + 24 : at + 28] = b"\x05\x04\xe8\x03"
            if level is not None:
                chunk[at + 28 : at + 31] = bytes((5, 1, level))
        out.append(bytes(chunk))
    return b"".join(out)


def frame(kind: str, size: int = 100) -> bytearray:
    """An Ethernet frame: ``tcp4``, ``udp4-vlan`` or ``tcp6``; ``tcp4-back`` is the reply to the first."""
    f = bytearray(size)
    if kind in ("tcp4", "tcp4-back"):
        f[12:14] = b"\x08\0"
        ends = [(bytes((10, 0, 0, 1)), 1234), (bytes((10, 0, 0, 2)), 80)]
        (src, sport), (dst, dport) = ends if kind == "tcp4" else ends[::-1]
        f[14], f[23] = 0x45, 6
        f[26:30], f[30:34] = src, dst
        f[34:38] = struct.pack(">HH", sport, dport)
    elif kind == "udp4-vlan":
        f[12:18] = b"\x81\0\0\x64\x08\0"
        f[18], f[27] = 0x45, 17
        f[30:34], f[34:38] = bytes((192, 168, 10, 1)), bytes((192, 168, 10, 2))
        f[38:42] = struct.pack(">HH", 1234, 53)
    else:
        f[12:14] = b"\x86\xdd"
        f[20] = 6
        f[22:38] = bytes.fromhex("fe800001").ljust(16, b"\0")
        f[38:54] = bytes.fromhex("fe800002").ljust(16, b"\0")
        f[54:58] = struct.pack(">HH", 8080, 443)
    return f


def frames(n: int) -> list[bytes]:
    """``n`` frames of the three kinds in turn; the sixth carries an executable's mark."""
    out = [frame(("tcp4", "udp4-vlan", "tcp6")[i % 3]) for i in range(n)]
    if n > 5:
        out[5][60:62] = b"MZ"
    return [bytes(f) for f in out]


def capture(packets: list[bytes], order: str = "<", nanoseconds: bool = False, cut: int = 0) -> bytes:
    """A capture with a packet a second; ``cut`` bytes are missing at the end."""
    magic = 0xA1B23C4D if nanoseconds else 0xA1B2C3D4
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65_535, 1)]
    out += [struct.pack(order + "IIII", 1_710_530_000 + k, 250, len(p), len(p)) + p for k, p in enumerate(packets)]
    data = b"".join(out)
    return data[: len(data) - cut]


def capture_ng(packets: list[bytes], order: str = "<") -> bytes:
    """A next-generation capture: a section, an interface and enhanced packets of microseconds."""

    def block(kind: int, body: bytes) -> bytes:
        body += b"\0" * (-len(body) % 4)
        size = struct.pack(order + "I", len(body) + 12)
        return struct.pack(order + "I", kind) + size + body + size

    out = [block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)), block(1, struct.pack(order + "HHI", 1, 0, 65_535))]
    for k, p in enumerate(packets):
        at = (1_710_530_000 + k) * 1_000_000 + 250
        out.append(block(6, struct.pack(order + "IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(p), len(p)) + p))
    return b"".join(out)


def packed(data: bytes, kind: str) -> bytes:
    """``data`` as gz, zst or xz."""
    if kind == "gz":
        return gzip.compress(data, mtime=0)
    if kind == "xz":
        return lzma.compress(data)
    import zstandard

    return zstandard.ZstdCompressor().compress(data)
