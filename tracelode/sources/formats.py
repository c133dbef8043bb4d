"""Format detection from a file's first bytes and its name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

# Magic numbers.
PCAP_MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("little", 1_000_000),
    b"\xa1\xb2\xc3\xd4": ("big", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("little", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": ("big", 1_000_000_000),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
EVTX_MAGIC = b"ElfFile\x00"
DELIMITERS = (",", "\t", ";", "|")
#: Extensions that name a format by themselves.
EXTENSIONS = {"json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet", "pcap": "pcap", "pcapng": "pcap", "evtx": "evtx", "log": "text", "txt": "text", "csv": "csv", "tsv": "csv"}
COMPRESSED = {"gz": "gzip", "zst": "zstd", "zstd": "zstd", "xz": "xz"}


@dataclass(frozen=True)
class Format:
    """A format of the user's own: whether a file's first bytes are of it, and its reader of (spark, paths)."""

    probe: Callable[[bytes], bool]
    read: Callable[[Any, list[str]], Any]


#: Registered formats by name, asked in the order of registration and before the built-in ones.
REGISTERED: dict[str, Format] = {}


def register(name: str, probe: Callable[[bytes], bool], read: Callable[[Any, list[str]], Any]) -> None:
    REGISTERED[name.lower()] = Format(probe, read)


def unregister(name: str) -> None:
    REGISTERED.pop(name.lower(), None)


def detect(head: bytes, name: str = "", forced: str | None = None) -> str:
    """A registered format, or parquet, pcap, evtx, json, csv or text; magic numbers come before anything else."""
    if forced:
        return forced.lower()
    for own, form in REGISTERED.items():
        if form.probe(head):
            return own
    if head.startswith(b"PAR1"):
        return "parquet"
    if head[:4] in PCAP_MAGICS or head.startswith(PCAPNG_MAGIC):
        return "pcap"
    if head.startswith(EVTX_MAGIC):
        return "evtx"
    body = head.removeprefix(b"\xef\xbb\xbf")
    if body.lstrip().startswith(b"{"):
        return "json"
    parts = [p for p in name.lower().split(".")[1:] if p not in COMPRESSED]
    if parts and parts[-1] in EXTENSIONS and not (EXTENSIONS[parts[-1]] == "csv" and not body):
        return EXTENSIONS[parts[-1]]
    return "csv" if delimiter(body) else "text"


def delimiter(head: bytes) -> str | None:
    """The delimiter that the first lines agree on, most frequent first; None if there is none."""
    lines = [s for s in head.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace").splitlines()[:20] if s.strip()]
    best = None
    for d in DELIMITERS:
        counts = [s.count(d) for s in lines]
        if counts and min(counts) > 0 and (best is None or sum(counts) > best[0]):
            best = (sum(counts), d)
    return best[1] if best else None


def quoted(head: bytes) -> bool:
    """Whether the first 8 KiB hold a double quote, so that quoting rules apply."""
    return b'"' in head[:8192]


def compression(name: str) -> str | None:
    return COMPRESSED.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
