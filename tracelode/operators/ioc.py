"""IP address extraction, noise detection and ranking."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ip_sort_key, ipv4_value, is_private_ip, noise_share
from .joins import range_join

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?![0-9])"
#: Not beside letters or digits, and not before a further dot.
IPV4 = rf"(?<![0-9A-Za-z]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z.])"
_V6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?![0-9A-Za-z])")
MODES = ("v4", "v6", "both")
#: What any address holds: cheap tests that spare most texts the decoding and the full patterns.
_V4_LIKE, _V6_LIKE = r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r":[0-9A-Fa-f]{0,4}:"


def v6_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, length, address) of the IPv6 addresses of a text; one trailing colon is not part of one."""
    out = []
    for m in _V6.finditer(text):
        raw = m[0]
        if raw.endswith(":") and not raw.endswith("::"):
            raw = raw[:-1]
        try:
            out.append((m.start(), len(raw), ipaddress.IPv6Address(raw).compressed))
        except ValueError:
            pass
    return out


def _plain_v4(ip: Column) -> Column:
    """A dotted quad without leading zeros."""
    return F.regexp_replace(ip, r"(?<![0-9])0+(?=[0-9])", "")


def _find_v4(df: DataFrame, raw: Column, latin1: Column, keep: list[str]) -> DataFrame:
    """(keep..., ip, noise) by splitting at each match; positions are running lengths."""
    hit = df.where(raw.rlike(_V4_LIKE)).select(
        *keep,
        latin1.alias("_t"),
        F.split(latin1, IPV4, -1).alias("_between"),
        F.regexp_extract_all(latin1, F.lit(IPV4), F.lit(0)).alias("_ips"),
    )
    hit = hit.select(*keep, F.posexplode(F.arrays_zip(F.slice("_between", 1, F.size("_ips")).alias("b"), F.col("_ips").alias("m"))).alias("_k", "x"), "_t", "_between", "_ips")
    # the window lies in the match and what stands around it, so positions are not needed
    before = F.right(F.coalesce(F.concat(F.when(F.col("_k") > 0, F.element_at("_ips", F.col("_k"))).otherwise(""), F.col("x.b")), F.lit("")), F.lit(16))
    after = F.substring(F.concat_ws("", F.element_at("_between", F.col("_k") + 2), F.when(F.col("_k") + 2 <= F.size("_ips"), F.element_at("_ips", F.col("_k") + 2))), 1, 16)
    around = F.concat(before, F.col("x.m"), after)
    return hit.select(*keep, _plain_v4(F.col("x.m")).alias("ip"), noise_share(around, F.length(before), F.length(F.col("x.m"))).alias("noise"))


def _find_v6(df: DataFrame, raw: Column, latin1: Column, keep: list[str]) -> DataFrame:
    """(keep..., ip, noise) of IPv6 addresses, validated in Arrow batches."""
    rows = df.where(F.contains(raw, F.lit(":")) & raw.rlike(_V6_LIKE)).select(*keep, latin1.alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", ip string, noise boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, ips, noise = [], [], []
            for k, text in enumerate(b.column("_t").to_pylist()):
                for at, size, ip in v6_spans(text):
                    window = text[max(0, at - 16) : at + size + 16]
                    odd = sum(not (" " <= c <= "~" or c in "\t\n\r") for c in window)
                    owner.append(k)
                    ips.append(ip)
                    noise.append(size <= 2 or odd * 100 > len(window) * 35)
            taken = b.take(pa.array(owner, pa.int64()))
            yield pa.record_batch([*taken.columns[:-1], pa.array(ips, pa.string()), pa.array(noise, pa.bool_())], [*taken.schema.names[:-1], "ip", "noise"])

    return rows.mapInArrow(run, schema)


def extract_ips(df: DataFrame, content: str, keep: list[str], mode: str = "both") -> DataFrame:
    """One row per address found in ``content``: the ``keep`` columns, ip and noise.

    Addresses do not overlap and are read left to right.  ``noise`` is set
    where over 35 % of the bytes around are not printable.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    latin1 = F.decode(F.col(content).cast("binary"), "ISO-8859-1")  # a character for each byte
    raw = F.col(content) if dict(df.dtypes)[content] == "string" else latin1
    parts = []
    if mode in ("v4", "both"):
        parts.append(_find_v4(df, raw, latin1, keep))
    if mode in ("v6", "both"):
        parts.append(_find_v6(df, raw, latin1, keep))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def frequencies(found: DataFrame, file_col: str) -> DataFrame:
    """(ip, file, hits, noise_hits)."""
    return found.groupBy("ip", F.col(file_col).alias("file")).agg(
        F.count("*").alias("hits"), F.sum(F.col("noise").cast("long")).alias("noise_hits")
    )


def rank(per_file: DataFrame, geo: DataFrame | None = None, top_files: int = 50) -> DataFrame:
    """(ip, count, is_noise, n_files, top_files[, country_code, country_name]) by count.

    An address is noise if all its hits are.  ``n_files`` counts all its files
    that have a name, also those past ``top_files``.  ``geo`` has range_start,
    range_end, code and name; private addresses have no country.  The top files
    are picked by a ranked window, so no address's files are gathered whole.
    """
    from pyspark.sql import Window as W

    totals = per_file.groupBy("ip").agg(
        F.sum("hits").alias("count"),
        (F.sum("hits") == F.sum("noise_hits")).alias("is_noise"),
        F.count("file").alias("n_files"),
    )
    place = F.row_number().over(W.partitionBy("ip").orderBy(F.desc("hits"), "file"))
    best = (
        per_file.withColumn("_n", place)
        .where(F.col("_n") <= top_files)
        .groupBy(F.col("ip").alias("_ip"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("n"), "file"))).alias("_f"))
        .select("_ip", F.transform("_f", lambda x: F.struct(x["file"].alias("path"), (-x["n"]).alias("count"))).alias("top_files"))
    )
    out = totals.join(best, F.col("ip") == F.col("_ip")).drop("_ip")
    if geo is not None:
        value = F.when(~is_private_ip(F.col("ip")) & ~F.contains("ip", F.lit(":")), ipv4_value(F.col("ip")))
        ranges = geo.select("range_start", "range_end", F.col("code").alias("country_code"), F.col("name").alias("country_name"))
        out = range_join(out.withColumn("_v", value), ranges, "_v", "range_start", "range_end").drop("_v", "range_start", "range_end")
    return out.orderBy(F.desc("count"), "ip")


def consolidate(reports: list[DataFrame], top_files: int = 50) -> DataFrame:
    """Rankings of several folders as one: counts add up, clean if clean anywhere."""
    every = reports[0]
    for r in reports[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    files = F.flatten(F.collect_list("top_files"))
    ordered = F.transform(F.sort_array(F.transform(files, lambda x: F.struct((-x["count"]).alias("n"), x["path"].alias("p")))), lambda x: F.struct(x["p"].alias("path"), (-x["n"]).alias("count")))
    return every.groupBy("ip").agg(
        F.sum("count").alias("count"), F.min("is_noise").alias("is_noise"), F.slice(ordered, 1, top_files).alias("top_files")
    ).orderBy(F.desc("count"), "ip")


def summary(ranked: DataFrame, shown: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(total_unique, total_hits, truncated) in one row, and the first ``shown`` addresses."""
    head = ranked.agg(
        F.count("*").alias("total_unique"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_hits"),
        (F.count("*") > shown).alias("truncated"),
    )
    return head, ranked.orderBy(F.desc("count"), "ip").limit(shown)


def refine(ranked: DataFrame, hide_private: bool = False, hide_noise: bool = False, holds: str = "", by: str = "hits") -> DataFrame:
    """The report's view: hidden rows, a substring, and order by hits or by address."""
    if hide_private:
        ranked = ranked.where(~is_private_ip(F.col("ip")))
    if hide_noise:
        ranked = ranked.where(~F.col("is_noise"))
    if holds:
        ranked = ranked.where(F.contains("ip", F.lit(holds)))
    return ranked.orderBy(F.desc("count"), "ip") if by == "hits" else ranked.orderBy(ip_sort_key(F.col("ip")))


def in_subnet(found: DataFrame, prefix: str) -> DataFrame:
    """Addresses that start with a text such as ``192.168.1.``."""
    return found.where(F.startswith("ip", F.lit(prefix)))


def report_lines(ranked: DataFrame) -> DataFrame:
    """The report's columns: IP Address, Total Hits, Origins (``path (n)`` joined by `` | ``)."""
    origins = F.array_join(F.transform("top_files", lambda x: F.concat(x["path"], F.lit(" ("), x["count"].cast("string"), F.lit(")"))), " | ")
    return ranked.select(F.col("ip").alias("IP Address"), F.col("count").alias("Total Hits"), origins.alias("Origins"))
