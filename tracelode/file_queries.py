"""Registered queries of the sources, sinks, edits, reports and scalar functions, over small files and tables of known answer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .api import Daemon, Dataset
from .blueprint import Blueprint, Field
from .functions import network, scalar
from .operators import delta, history, ioc, profile, report, search, zones
from .options import AnalysisProfile, ProfileStore, ReadOptions
from .plans import predicate
from .queries import _t, query
from .scratch import put, scratch
from .sources import evtx, export, files, formats, pcap
from .sources.dataset import rows_between, text_lines, with_row_idx

_PREAMBLE = "﻿report of the day;;\nmade by hand;;\nid;name;price\r\n1;Ada;10.5\r\n2;Ben;x\r\n3;;7\r\n"
_QUOTED = 'id,name,note\n1,"Smith, Ann","said ""yes"""\n2,"two\nlines",\n3,plain,"a,b,c"\n'
_TYPED = 'n,cost,ok,day,word\n1,$5.50,true,2024-02-29,a\n-2.5,"$1,000",false,1999-12-31 10:00,b\n'
_LOG = "alpha 10.0.0.1 start\nbeta stop\n\ngamma 10.0.0.2 start\n"


def _file(spark: SparkSession, name: str, data: bytes | str) -> str:
    """A sample file in a folder of its own."""
    return put(spark, f"{scratch(spark, 'sample')}/{name}", data.encode() if isinstance(data, str) else data)


def _rows(spark: SparkSession, values: list, ddl: str) -> DataFrame:
    return spark.createDataFrame(values, ddl)


# --- opening files ------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('1', 'Ada', '10.5'), ('2', 'Ben', 'x'), ('3', NULL, '7')) AS t(id, name, price)")
def read_csv_preamble(spark, sf_dir):
    return Dataset(spark, _file(spark, "day.csv", _PREAMBLE), ReadOptions(skip_rows=2)).frame


@query("SELECT * FROM (VALUES ('1', 'Smith, Ann', 'said \"yes\"'), ('2', 'two' || chr(10) || 'lines', NULL), ('3', 'plain', 'a,b,c')) AS t(id, name, note)")
def read_csv_quoted(spark, sf_dir):
    return Dataset(spark, _file(spark, "q.csv", _QUOTED), ReadOptions(multi_line=True)).frame


@query("SELECT * FROM (VALUES (1.0::DOUBLE, 5.5::DOUBLE, true, DATE '2024-02-29', 'a'), (-2.5, 1000, false, DATE '1999-12-31', 'b')) AS t(n, cost, ok, day, word)")
def read_csv_typed(spark, sf_dir):
    return Dataset(spark, _file(spark, "t.csv", _TYPED), ReadOptions(infer=True)).frame


@query("SELECT * FROM (VALUES ('1', 'a b'), ('2', 'c')) AS t(id, name)")
def read_csv_stripped(spark, sf_dir):
    text = 'id|name\n"1"|"a b"\n"2"|c\n'
    return Dataset(spark, _file(spark, "s.csv", text), ReadOptions(rfc_4180=False, strip_quotes=True)).frame


@query("SELECT * FROM (VALUES (0::BIGINT, 'alpha 10.0.0.1 start'), (1, 'beta stop'), (2, ''), (3, 'gamma 10.0.0.2 start')) AS t(row_idx, line)")
def read_log(spark, sf_dir):
    return text_lines(spark, _file(spark, "a.log", _LOG)).select("row_idx", "line")


@query(
    "SELECT * FROM (VALUES ('a.csv', 'csv', ','), ('a.tsv', 'csv', chr(9)), ('a.dat', 'csv', ';'), ('b.dat', 'text', NULL), ('a.json', 'json', NULL), "
    "('c.dat', 'json', ','), ('a.bin', 'pcap', NULL), ('b.bin', 'pcap', NULL), ('a.evt', 'evtx', NULL), ('a.csv.gz', 'csv', ','), ('p', 'parquet', NULL)) AS t(name, format, delimiter)"
)
def detect_formats(spark, sf_dir):
    heads = {
        "a.csv": b"a,b\n1,2\n", "a.tsv": b"a\tb\n1\t2\n", "a.dat": b"a;b\n1;2\n", "b.dat": b"no delimiter\n", "a.json": b"{}", "c.dat": b' {"a": 1, "b": 2}',
        "a.bin": b"\xd4\xc3\xb2\xa1", "b.bin": b"\x0a\x0d\x0d\x0a", "a.evt": b"ElfFile\0", "a.csv.gz": b"a,b\n", "p": b"PAR1",
    }
    return _rows(spark, [(n, formats.detect(h, n), formats.delimiter(h)) for n, h in heads.items()], "name string, format string, delimiter string")


@query("SELECT * FROM (VALUES ('gz', '1', 'x'), ('gz', '2', 'y'), ('xz', '1', 'x'), ('xz', '2', 'y'), ('zst', '1', 'x'), ('zst', '2', 'y')) AS t(kind, id, name)")
def read_compressed(spark, sf_dir):
    out = None
    for kind in ("gz", "xz", "zst"):
        got = Dataset(spark, _file(spark, f"c.csv.{kind}", samples.packed(b"id,name\n1,x\n2,y\n", kind))).frame.select(F.lit(kind).alias("kind"), "id", "name")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT 'part-' || k || '.csv' AS name, CAST(i AS BIGINT) AS row_idx, CAST(k * 10 + i AS VARCHAR) AS v FROM range(3) a(k), range(4) b(i)")
def read_folder_numbered(spark, sf_dir):
    folder = scratch(spark, "folder")
    for k in range(3):
        put(spark, f"{folder}/part-{k}.csv", ("v,w\n" + "".join(f"{10 * k + i},z\n" for i in range(4))).encode())
    put(spark, f"{folder}/node_modules/hidden.csv", b"v,w\n99,z\n")
    put(spark, f"{folder}/.git/hidden.csv", b"v,w\n98,z\n")
    got = Dataset(spark, folder).numbered
    return got.select(F.regexp_extract("file", "[^/]+$", 0).alias("name"), "row_idx", "v")


def _tree(spark: SparkSession) -> str:
    folder = scratch(spark, "tree")
    for name in ("Report.PDF", "notes.txt", "src/main.rs", "src/report.py", "img/Photo.JPG", ".hidden/report.doc"):
        put(spark, f"{folder}/{name}", name.encode())
    return folder


@query(
    "SELECT * FROM (VALUES ('report', 'Report.PDF', 10::BIGINT, false), ('report', 'src/report.py', 13, false), ('report', '.hidden/report.doc', 18, false), ('type:doc', '.hidden/report.doc', 18, false), "
    "('type:doc', 'Report.PDF', 10, false), ('type:doc', 'notes.txt', 9, false), ('.rs', 'src/main.rs', 11, false), ('type:image pho', 'img/Photo.JPG', 13, false), ('src', 'src', 0, true)) AS t(query, name, size, is_dir)"
)
def find_files(spark, sf_dir):
    tree = _tree(spark)
    out = None
    for q in ("report", "type:doc", ".rs", "type:image pho", "src"):
        got = files.find_files(spark, tree, q).select(F.lit(q).alias("query"), F.regexp_extract("path", "/tree-[0-9a-f]+/(.*)$", 1).alias("name"), "size", "is_dir")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT 2::BIGINT AS files, 5::BIGINT AS total_rows, 'a,b' AS columns, 23 AS bytes")
def dataset_metadata(spark, sf_dir):
    folder = scratch(spark, "meta")
    put(spark, f"{folder}/x.csv", b"a,b\n1,2\n3,4\n")
    put(spark, f"{folder}/y.csv", b"a,b\n5,6\n7\n8")
    m = Dataset(spark, folder).metadata()
    return m.select("files", "total_rows", F.array_join("columns", ",").alias("columns"), F.round(F.col("total_mib") * 1024 * 1024).cast("int").alias("bytes"))


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 4::BIGINT), (1, 5, 0), (2, 6, 6), (3, 13, 2)) AS t(row_idx, \"offset\", length)")
def row_index(spark, sf_dir):
    return export.row_index(text_lines(spark, _file(spark, "i.txt", "abcd\n\nhéllo\nzz\n"))).select("row_idx", "offset", "length")


@query(
    "SELECT * FROM (VALUES (0::BIGINT, 4::BIGINT, sha256('abcd')), (1, 4, sha256('efgh')), (2, 2, sha256('ij'))) AS t(block, length, sha256)"
)
def block_hashes(spark, sf_dir):
    return export.block_hashes(spark, _file(spark, "h.bin", b"abcdefghij"), 4).select("block", "length", "sha256")


# --- packets and event logs ---------------------------------------------------------------------------------------


@query("SELECT 300::BIGINT AS packets, 30000::BIGINT AS bytes, 3::BIGINT AS flows, 200::BIGINT AS tcp, 100::BIGINT AS udp, 1::BIGINT AS suspicious")
def pcap_summary(spark, sf_dir):
    return pcap.summarise(pcap.read_packets(spark, _file(spark, "a.pcap", samples.capture(samples.frames(300)))))


@query(
    "SELECT kind, CAST(i AS BIGINT) AS packet, CAST(1710530000 + i AS BIGINT) AS ts_sec, ns AS ts_nsec, 100::BIGINT AS orig_len FROM range(4) r(i), "
    "(VALUES ('little', 250000::BIGINT), ('big', 250000), ('nano', 250), ('ng', 250000), ('ng-big', 250000)) AS k(kind, ns) UNION ALL "
    "SELECT 'cut', CAST(i AS BIGINT), CAST(1710530000 + i AS BIGINT), 250000, 100 FROM range(3) r(i)"
)
def pcap_variants(spark, sf_dir):
    four = samples.frames(4)
    kinds = {
        "little": samples.capture(four), "big": samples.capture(four, ">"), "nano": samples.capture(four, nanoseconds=True), "cut": samples.capture(four, cut=7),
        "ng": samples.capture_ng(four), "ng-big": samples.capture_ng(four, ">"),
    }
    folder = scratch(spark, "pcaps")
    paths = [put(spark, f"{folder}/{k}.pcap", d) for k, d in kinds.items()]
    kind = F.regexp_extract("file", "([a-z-]+)[.]pcap$", 1).alias("kind")
    return pcap.read_packets(spark, paths).select(kind, "packet", "ts_sec", "ts_nsec", "orig_len")


@query(
    "SELECT * FROM (VALUES ('0A000001', 1234, '0A000002', 80, 6, 3::BIGINT), ('C0A80A01', 1234, 'C0A80A02', 53, 17, 1), "
    "('FE800001000000000000000000000000', 8080, 'FE800002000000000000000000000000', 443, 6, 1)) AS t(low_ip, low_port, high_ip, high_port, protocol, n)"
)
def pcap_flows(spark, sf_dir):
    data = [samples.frame(k) for k in ("tcp4", "tcp4-back", "udp4-vlan", "tcp6", "tcp4")] + [b"too short"]
    got = pcap.with_flows(pcap.read_packets(spark, _file(spark, "f.pcap", samples.capture([bytes(d) for d in data])))).where("flow IS NOT NULL")
    plain = lambda ip: F.regexp_replace(F.hex(ip), "^0{20}FFFF", "")
    ends = got.select(plain(F.col("flow.low.ip")).alias("low_ip"), F.col("flow.low.port").alias("low_port"), plain(F.col("flow.high.ip")).alias("high_ip"), F.col("flow.high.port").alias("high_port"), F.col("flow.protocol").alias("protocol"))
    return ends.groupBy(*ends.columns).agg(F.count("*").alias("n"))


@query("SELECT true AS same_flow, true AS same_hash, false AS other_hash")
def flow_symmetry(spark, sf_dir):
    ends = _rows(spark, [("a", 10, "b", 20)], "s string, sp int, d string, dp int")
    one = network.canonical_flow(F.col("s"), F.col("sp"), F.col("d"), F.col("dp"), F.lit(6))
    two = network.canonical_flow(F.col("d"), F.col("dp"), F.col("s"), F.col("sp"), F.lit(6))
    other = network.canonical_flow(F.col("s"), F.col("sp"), F.col("d"), F.col("dp"), F.lit(17))
    return ends.select((one == two).alias("same_flow"), (network.flow_hash(one) == network.flow_hash(two)).alias("same_hash"), (network.flow_hash(one) == network.flow_hash(other)).alias("other_hash"))


@query(
    "SELECT * FROM (VALUES (0, 'PE Executable'), (1, 'ZIP/Office'), (2, 'PDF Document'), (3, 'ELF Binary'), (4, 'PNG Image'), (5, 'PE Executable'), (6, NULL), (7, NULL), (8, 'PDF Document')) AS t(k, kind)"
)
def payload_kinds(spark, sf_dir):
    data = [b"MZ", b"PK\x03\x04x", b"%PDF-1", b"\x7fELF", b"\x89PNG", b"\0" * 10 + b"MZ" + b"\0" * 52, b"none", b"\0" * 256 + b"MZ", b"%PDF MZ"]
    return _rows(spark, [(k, bytearray(d)) for k, d in enumerate(data)], "k int, payload binary").select("k", network.payload_kind(F.col("payload")).alias("kind"))


@query("SELECT 60::BIGINT AS total, 0::BIGINT AS errors, 0::BIGINT AS warnings, 60::BIGINT AS info")
def evtx_summary(spark, sf_dir):
    return evtx.summarise(evtx.read_records(spark, _file(spark, "a.evtx", samples.event_log())))


@query(
    "SELECT 4096 + c * 65536 + 512 + i * 128 AS \"offset\", CAST(c * 5 + i + 1 AS BIGINT) AS record_id, CASE WHEN c = 0 AND i = 0 THEN 0 ELSE 1705526400 + i END AS unix_seconds, 1000 AS event_id, 2 AS level "
    "FROM range(2) a(c), range(5) b(i)"
)
def evtx_records(spark, sf_dir):
    got = evtx.read_records(spark, _file(spark, "b.evtx", samples.event_log(2, 5, level=2)))
    return got.select("offset", F.col("record_id").cast("long").alias("record_id"), "unix_seconds", "event_id", "level")


@query("SELECT 10::BIGINT AS total, 10::BIGINT AS errors, 0::BIGINT AS warnings, 0::BIGINT AS info")
def evtx_carved(spark, sf_dir):
    torn = b"junk" * 100 + samples.event_log(2, 5, level=1)[4096:]
    return evtx.summarise(evtx.read_records(spark, _file(spark, "c.bin", torn), carve=True))


@query("SELECT * FROM (VALUES (1, 4::BIGINT), (1, 10), (2, 0), (2, 2), (3, 128)) AS t(k, \"offset\")")
def signature_carve(spark, sf_dir):
    data = [b"...." + b"abab" + b".." + b"abab", b"ababab", b"\0" * 128 + b"abab", b"nothing"]
    return evtx.carve_signature(_rows(spark, [(k + 1, bytearray(d)) for k, d in enumerate(data)], "k int, data binary"), "data", b"abab", ["k"])


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (100, 0), (116444736000000000, 0), (116444736010000000, 1), (133500000000000000, 1705526400)) AS t(ft, seconds)")
def filetimes(spark, sf_dir):
    return _rows(spark, [(x,) for x in (0, 100, 116444736000000000, 116444736010000000, 133500000000000000)], "ft bigint").select("ft", network.filetime_seconds(F.col("ft")).alias("seconds"))


# --- sinks --------------------------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation WHERE n_regionkey >= 2 AND n_nationkey BETWEEN 3 AND 20")
def export_csv_rows(spark, sf_dir):
    path = scratch(spark, "export")
    export.export_csv(_t(spark, sf_dir, "nation"), path, "n_nationkey", filter_text="$2 >= 2", number_range=("n_nationkey", 3, 20))
    return spark.read.csv(path, header=True)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '7')")
def export_json_rows(spark, sf_dir):
    path = scratch(spark, "export")
    export.export_json(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path, text=("s_name", "7"))
    return spark.read.schema("s_suppkey string, s_name string").json(path)


@query("""SELECT '[{"r_regionkey":"0","r_name":"' || min(r_name) FILTER (r_regionkey = 0) || '"},{"r_regionkey":"1","r_name":"' || min(r_name) FILTER (r_regionkey = 1) || '"}]' AS rows FROM region""")
def json_response(spark, sf_dir):
    return _rows(spark, [(export.json_array(_t(spark, sf_dir, "region").orderBy("r_regionkey"), 2),)], "rows string")


@query("SELECT * FROM (VALUES ('alpha 10.0.0.1 start'), ('gamma 10.0.0.2 start')) AS t(value)")
def export_matches(spark, sf_dir):
    path = scratch(spark, "matches")
    export.export_matches(text_lines(spark, _file(spark, "m.log", _LOG)), "START", path, ignore_case=True)
    return spark.read.text(path)


@query("SELECT * FROM (VALUES ('1.2.3.4', '3', 'b (2) | a (1)'), ('5.6.7.8', '1', 'a (1)')) AS t(\"IP Address\", \"Total Hits\", \"Origins\")")
def export_ip_report(spark, sf_dir):
    path = scratch(spark, "report")
    found = _rows(spark, [("a", "1.2.3.4 and 5.6.7.8"), ("b", "1.2.3.4,1.2.3.4")], "file string, line string")
    export.export_ip_report(ioc.rank(ioc.frequencies(ioc.extract_ips(found, "line", ["file"]), "file")), path)
    return spark.read.csv(path, header=True)


@query(
    "SELECT row_idx // 1000 AS zone, min(row_idx) AS start_row, max(row_idx) + 1 AS end_row, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice "
    "FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders) GROUP BY 1"
)
def zone_map_saved(spark, sf_dir):
    path = scratch(spark, "zones")
    zones.save(zones.zone_map(with_row_idx(_t(spark, sf_dir, "orders"), "o_orderkey"), ["o_totalprice"], size=1000), path)
    return zones.load(spark, path, ["o_totalprice"])


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def ingest_append(spark, sf_dir):
    from .streaming.ingest import append, read_stream

    path, target = f"{sf_dir}/events.parquet", scratch(spark, "ingested")
    stream = read_stream(spark, path, spark.read.parquet(path).schema)
    for _ in range(2):  # the second run finds nothing new
        append(stream, target, target + "-state").awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT true AS counted_all, true AS in_batches, count(*) AS rows FROM events")
def ingest_progress(spark, sf_dir):
    from time import sleep

    from .streaming.ingest import Progress, append, read_stream

    path, target, seen = f"{sf_dir}/events.parquet", scratch(spark, "progress"), Progress()
    spark.streams.addListener(seen)
    try:
        append(read_stream(spark, path, spark.read.parquet(path).schema), target, target + "-state").awaitTermination()
        n = spark.read.parquet(target).count()
        for _ in range(300):  # events reach listeners a little later
            if seen.rows >= n:
                break
            sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    return _rows(spark, [(seen.rows == n, seen.batches > 0, n)], "counted_all boolean, in_batches boolean, rows bigint")


@query(
    "SELECT 'before' AS at, 'a' AS source, 2 AS scans, count(*) AS latest_count FROM customer UNION ALL SELECT 'before', 'b', 1, (SELECT count(*) FROM supplier) UNION ALL SELECT 'after', 'b', 1, (SELECT count(*) FROM supplier)"
)
def scan_history(spark, sf_dir):
    path, kept = scratch(spark, "history"), scratch(spark, "history-kept")
    customers, suppliers = (profile.numeric_profile(_t(spark, sf_dir, t), [c]) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal")))
    history.record(suppliers, path, "a", tag="first")
    history.record(customers, path, "a", content_hash="x")
    history.record(suppliers, path, "b")

    def state(at: str, where: str, sources: list[str]) -> list[tuple]:
        n = dict(history.scans(spark, where).groupBy("source").count().collect())
        return [(at, s, n[s], history.latest(spark, where, s).first()["count"]) for s in sources]

    out = state("before", path, ["a", "b"])
    history.delete(spark, path, "a", kept)
    return _rows(spark, out + state("after", kept, ["b"]), "at string, source string, scans int, latest_count bigint")


@query("SELECT * FROM (VALUES ('big.csv', '2000000000', '4.0', '500.0'), ('huge.csv', '3000000000', '1.5', '2000.0')) AS t(source, bytes, seconds, mb_per_s)")
def telemetry_log(spark, sf_dir):
    path = scratch(spark, "telemetry")
    for source, size, seconds in (("big.csv", 2 * 10**9, 4.0), ("small.csv", 10**6, 1.0), ("huge.csv", 3 * 10**9, 1.5)):
        history.log_telemetry(spark, path, source, size, 1000, seconds)
    return spark.read.csv(path, header=True).select("source", "bytes", "seconds", "mb_per_s")


# --- scalar functions ---------------------------------------------------------------------------------------------

_CELLS = ["1", " 2.5 ", "-3e2", "", " ", "12abc", "1,234", "+7", ".5", "1.0d", "NaN", None, '"4"', "1e5x", "0x10", "- 1"]


@query(
    "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE), (1, 2.5, 2.5), (2, -300, -3), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, 12), (6, NULL, 1), (7, 7, 7), (8, 0.5, 0.5), (9, NULL, 1), "
    "(11, NULL, NULL), (12, NULL, 4), (13, NULL, 1), (14, NULL, 0), (15, NULL, NULL)) AS t(k, strict, prefix)"
)
def text_numbers(spark, sf_dir):
    cells = _rows(spark, [(k, c) for k, c in enumerate(_CELLS) if c != "NaN"], "k int, c string")
    return cells.select("k", scalar.strict_number(F.col("c")).alias("strict"), scalar.numeric_prefix(F.col("c")).alias("prefix"))


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'a b'), (2, '\"'), (3, ''), (4, '\"x\"'), (5, 'say \"hi\"'), (6, NULL)) AS t(k, c)")
def unquoted(spark, sf_dir):
    cells = [(k, c) for k, c in enumerate(['"a"', ' "a b" ', '"', '""', '""x""', 'say "hi"', None])]
    return _rows(spark, cells, "k int, c string").select("k", scalar.unquote(F.col("c")).alias("c"))


@query(
    "SELECT * FROM (VALUES ('10.1.2.3', true), ('172.15.0.1', false), ('172.16.0.1', true), ('172.31.255.255', true), ('172.32.0.0', false), ('192.168.0.9', true), ('127.0.0.1', true), ('169.254.1.1', true), "
    "('8.8.8.8', false), ('::1', true), ('fe80::1', false), ('11.0.0.0', false)) AS t(ip, private)"
)
def private_addresses(spark, sf_dir):
    ips = "10.1.2.3 172.15.0.1 172.16.0.1 172.31.255.255 172.32.0.0 192.168.0.9 127.0.0.1 169.254.1.1 8.8.8.8 ::1 fe80::1 11.0.0.0".split()
    return _rows(spark, [(i,) for i in ips], "ip string").select("ip", scalar.is_private_ip(F.col("ip")).alias("private"))


@query("SELECT * FROM (VALUES (1, '8.8.8.8', false), (2, '8.8.8.8', true), (3, '8.8.8.8', false), (4, '8.8.8.8', true), (5, '::', true), (5, '8.8.8.8', false)) AS t(k, ip, noise)")
def noise_flags(spark, sf_dir):
    # 3: five of 17 bytes are not printable; 4: two-byte letters count twice
    data = [(1, "see 8.8.8.8 here"), (2, "\x01" * 9 + "8.8.8.8" + "\x02"), (3, "\x01" * 5 + " 8.8.8.8 abc" + "\x7f"), (4, "é" * 8 + " 8.8.8.8"), (5, "a :: b" + "." * 30 + " 8.8.8.8")]
    return ioc.extract_ips(_rows(spark, data, "k int, text string"), "text", ["k"])


@query(
    "SELECT * FROM (VALUES (0, '1.5B'), (1, '2.0M'), (2, '-3.2K'), (3, '999.00'), (4, '0.00'), (5, '-'), (6, '-'), (7, '-')) AS t(k, shown)"
)
def compact_numbers(spark, sf_dir):
    values = [1.5e9, 2e6, -3200.0, 999.0, 0.0, float("nan"), float("inf"), None]
    return _rows(spark, list(enumerate(values)), "k int, v double").select("k", scalar.compact(F.col("v")).alias("shown"))


@query("SELECT * FROM (VALUES ('AR', '🇦🇷'), ('de', '🇩🇪'), ('', ''), ('USA', ''), ('1A', '')) AS t(code, flag)")
def country_flags(spark, sf_dir):
    return _rows(spark, [(c,) for c in ("AR", "de", "", "USA", "1A")], "code string").select("code", scalar.flag_emoji(F.col("code")).alias("flag"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS FLOAT) AS v FROM lineitem")
def column_vector(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", scalar.number("double", F.col("l_quantity")).cast("float").alias("v"))


# --- predicates over text cells -----------------------------------------------------------------------------------


def _text_orders(spark, sf_dir) -> DataFrame:
    """Orders with a text price; every seventh has letters behind it, every eleventh none."""
    price = F.format_string("%.2f", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 11 == 0, "").when(F.col("o_orderkey") % 7 == 0, F.concat(price, F.lit(" usd"))).otherwise(price)
    return _t(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND round(o_totalprice, 2) > 150000")
def filter_text_strict(spark, sf_dir):
    return predicate.where(_text_orders(spark, sf_dir), "$1 > 150000").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 AND round(o_totalprice, 2) BETWEEN 20000 AND 30000")
def filter_text_prefix(spark, sf_dir):
    return predicate.in_range(_text_orders(spark, sf_dir), "price", 20000, 30000).select("o_orderkey")


# --- search -------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (false, 'a', 1), (false, '# b', 2), (false, 'c d', 3), (true, 'a', 1), (true, 'c d', 2)) AS t(comments, indicator, place)")
def indicator_lists(spark, sf_dir):
    lines = [" a ", "", "# b", "  ", "c d\r"]
    rows = [(c, i, k) for c in (False, True) for k, i in enumerate(search.indicator_list(lines, c), 1)]
    return _rows(spark, rows, "comments boolean, indicator string, place int")


@query(
    "SELECT indicator, doc_id, len(string_split(lower(text), indicator)) - 1 AS hits FROM documents, (SELECT 'mail' || i || '.example.com' AS indicator FROM range(100) r(i)) "
    "WHERE contains(lower(text), indicator)"
)
def ioc_long_list(spark, sf_dir):
    return search.indicators(_t(spark, sf_dir, "documents"), "text", [f"mail{i}.example.com" for i in range(100)], ["doc_id"])


@query("SELECT * FROM (VALUES (0::BIGINT, 15::BIGINT, 'alpha 10.0.0.1 start'), (1, 5, 'beta stop'), (3, 15, 'gamma 10.0.0.2 start')) AS t(row_idx, \"offset\", line)")
def search_hybrid(spark, sf_dir):
    return Dataset(spark, _file(spark, "hy.log", _LOG), ReadOptions(has_header=False)).hybrid("ST").select("row_idx", "offset", "line")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS p FROM documents) WHERE substr(t, CAST(p AS INT), 3) = 'ere' GROUP BY doc_id")
def search_overlapping(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    # erere holds two that overlap
    return docs.select("doc_id", search.occurrence_count(F.col("text"), "ere").cast("long").alias("n")).where("n > 0")


@query(
    "SELECT 'jump' AS box, doc_id FROM documents WHERE doc_id = 17 UNION ALL (SELECT 'text', doc_id FROM documents WHERE contains(lower(text), 'licensed') ORDER BY doc_id LIMIT 10)"
)
def viewer_box(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    jump, text = (search.viewer(docs, q, "text", "doc_id").select(F.lit(b).alias("box"), "doc_id") for b, q in (("jump", " 17 "), ("text", "LICENSED")))
    return jump.unionByName(text)


@query("SELECT 3 AS matches")
def search_benchmark(spark, sf_dir):
    return _rows(spark, [(Dataset(spark, _file(spark, "sb.log", _LOG), ReadOptions(has_header=False)).benchmark_search("St")["matches"],)], "matches int")


@query(
    "SELECT * FROM (VALUES (1, '{\"status\": \"ok\", \"total_rows\": 2, \"skip_rows\": 0, \"columns\": [\"a\", \"b\"]}'), (2, '{\"status\": \"ok\", \"rows\": [\"3,y\"]}'), (3, '{\"status\": \"ok\", \"rows\": [0, 1]}'), "
    "(4, '{\"status\": \"error\", \"message\": \"unknown command ''nope''\"}'), (5, '{\"status\": \"ok\"}')) AS t(k, reply)"
)
def daemon_requests(spark, sf_dir):
    daemon = Daemon(Dataset(spark, _file(spark, "d.csv", "a,b\n1,x7\n3,y\n")))
    requests = [{"command": "metadata"}, {"command": "get_rows", "start": 1, "limit": 5}, {"command": "search", "query": ","}, {"method": "nope"}, {"command": "exit"}]
    return _rows(spark, [(k, daemon.handle(json.dumps(r))) for k, r in enumerate(requests, 1)], "k int, reply string")


@query("SELECT row_idx, c_custkey FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_custkey FROM customer) WHERE row_idx BETWEEN 40 AND 59")
def view_rows(spark, sf_dir):
    return rows_between(with_row_idx(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), 40, 60).select("row_idx", "c_custkey")


# --- addresses ----------------------------------------------------------------------------------------------------


@query(
    "SELECT * FROM (VALUES (1, 'fe80::1'), (2, '::1'), (3, '2001:db8::8a2e:370:7334'), (4, '1:2:3:4:5:6:7:8'), (5, 'fe80::1'), (9, '10.0.0.1'), (9, 'fe80::2'), (11, '::')) AS t(k, ip)"
)
def ipv6_extract(spark, sf_dir):
    texts = ["at fe80::1 now", "[::1]", "2001:0db8:0:0:0:8a2e:0370:7334", "1:2:3:4:5:6:7:8", "fe80::1:", "12:34:56", "1::2::3", "1:2:3:4:5:6:7", "fe80::2 10.0.0.1", "xfe80::1", "::", "12345::1"]
    return ioc.extract_ips(_rows(spark, list(enumerate(texts, 1)), "k int, text string"), "text", ["k"]).select("k", "ip")


_RANKED = "ip string, count bigint, is_noise boolean, n_files bigint, top_files array<struct<path:string,count:bigint>>"


@query("SELECT * FROM (VALUES ('1.1.1.1', 7::BIGINT, false, 'b:4,a:3'), ('2.2.2.2', 1, true, 'a:1')) AS t(ip, count, is_noise, files)")
def ip_consolidated(spark, sf_dir):
    one = _rows(spark, [("1.1.1.1", 3, True, 1, [("a", 3)]), ("2.2.2.2", 1, True, 1, [("a", 1)])], _RANKED)
    two = _rows(spark, [("1.1.1.1", 4, False, 1, [("b", 4)])], _RANKED)
    shown = F.array_join(F.transform("top_files", lambda x: F.concat_ws(":", x["path"], x["count"].cast("string"))), ",")
    return ioc.consolidate([one, two]).select("ip", "count", "is_noise", shown.alias("files"))


@query(
    "SELECT * FROM (VALUES ('clean', 0, '9.9.9.9'), ('clean', 1, '8.8.8.8'), ('by ip', 0, '8.8.8.8'), ('by ip', 1, '9.9.9.9'), ('by ip', 2, '10.0.0.1'), ('by ip', 3, '::1'), ('holds', 0, '10.0.0.1'), ('subnet', 0, '9.9.9.9')) AS t(view, place, ip)"
)
def ip_views(spark, sf_dir):
    rows = [("8.8.8.8", 2, False, 1, []), ("10.0.0.1", 5, False, 1, []), ("9.9.9.9", 4, False, 1, []), ("::1", 3, True, 1, [])]
    ranked = _rows(spark, rows, _RANKED)
    views = {
        "clean": ioc.refine(ranked, hide_private=True, hide_noise=True), "by ip": ioc.refine(ranked, by="ip"), "holds": ioc.refine(ranked, holds="0.0"),
        "subnet": ioc.in_subnet(ranked, "9.9."),
    }
    return _rows(spark, [(v, k, r.ip) for v, df in views.items() for k, r in enumerate(df.collect())], "view string, place int, ip string")


# --- profiles and reports -----------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def row_count(spark, sf_dir):
    return predicate.select_rows(_t(spark, sf_dir, "orders"), "$2 = 'F' && $3 > 100000").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('c_acctbal', 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE)) AS t(\"column\", count, mean, min, max, health_score)")
def profile_empty(spark, sf_dir):
    return profile.numeric_profile(_t(spark, sf_dir, "customer").where("c_custkey < 0"), ["c_acctbal"]).select("column", "count", "mean", "min", "max", "health_score")


@query(
    "SELECT * FROM (VALUES ('flat', 100::BIGINT, 0::BIGINT, 80.0::DOUBLE, 'constant', true), ('mostly_null', 20, 80, 70.0, 'sparse', false), ('skewed', 100, 0, 90.0, 'skewed', false), "
    "('plain', 100, 0, 100.0, '', false), ('all_null', 0, 100, 70.0, 'sparse', false)) AS t(\"column\", count, null_count, health_score, warnings, is_constant)"
)
def profile_health(spark, sf_dir):
    rows = spark.range(100).select(
        F.lit(4.0).alias("flat"),
        F.when(F.col("id") < 20, F.col("id").cast("double")).alias("mostly_null"),
        F.when(F.col("id") == 99, 1e6).otherwise(1.0).alias("skewed"),
        F.col("id").cast("double").alias("plain"),
        F.lit(None).cast("double").alias("all_null"),
    )
    return profile.numeric_profile(rows).select("column", "count", "null_count", "health_score", "warnings", "is_constant")


@query(
    "SELECT level, count(*) AS count, round(avg(l_quantity), 4) AS mean, "
    "CASE WHEN level = 'basic' THEN NULL ELSE 0 END AS distinct_count, CASE WHEN level = 'full' THEN sum(CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 1 ELSE 0 END)::BIGINT END AS out_of_range "
    "FROM lineitem, (VALUES ('basic'), ('discovery'), ('full')) AS v(level) GROUP BY level"
)
def profile_levels(spark, sf_dir):
    out = None
    for level in profile.LEVELS:
        got = profile.profile(_t(spark, sf_dir, "lineitem"), ["l_quantity"], level, limits={"l_quantity": (5.0, 45.0)})
        some = lambda c, got=got: (F.col(c) if c in got.columns else F.lit(None)).cast("bigint").alias(c)
        got = got.select(F.lit(level).alias("level"), "count", F.round("mean", 4).alias("mean"), some("distinct_count"), some("out_of_range"))
        out = got if out is None else out.unionByName(got)
    return out


@query(
    "SELECT 6::BIGINT AS columns, 1999 AS first_year, 2001 AS last_year, 3::BIGINT AS n_years, 2::BIGINT AS n_indicators, 3::BIGINT AS n_places, round(100 * (1 - 4 / 24.0), 4) AS integrity, 'excellent' AS grade"
)
def executive_report(spark, sf_dir):
    data = [("Chad", "gdp", 1.0, 2.0, None, "x"), ("Peru", "gdp", 3.0, None, 4.0, "y"), ("Cuba", "co2", 5.0, 6.0, 7.5, None), (None, "co2", 1.5, 2.5, 3.5, "z")]
    rows = _rows(spark, data, "Country string, `Indicator Name` string, `1999` double, `2000` double, `2001` double, other string")
    return report.executive(profile.profile(rows)).select("columns", "first_year", "last_year", "n_years", "n_indicators", "n_places", F.round("integrity", 4).alias("integrity"), "grade")


@query("SELECT * FROM (VALUES ('key', 'primary', '', 100::BIGINT), ('group', 'low', 'a 60.0|b 30.0|c 10.0', 100), ('half', 'high', 'v0 2.0|v1 2.0|v10 2.0', 100)) AS t(\"column\", uniqueness, top, count)")
def column_cards(spark, sf_dir):
    k = F.col("id")
    rows = spark.range(100).select(
        F.concat(F.lit("k"), k).alias("key"), F.when(k < 60, "a").when(k < 90, "b").otherwise("c").alias("group"), F.concat(F.lit("v"), F.floor(k / 2)).alias("half")
    )
    top = F.array_join(F.transform("top", lambda t: F.concat_ws(" ", t["value"], t["percent"].cast("string"))), "|")
    cards = report.cards(profile.profile(rows))
    return cards.select("column", "uniqueness", F.when(F.col("column") == "key", "").otherwise(top).alias("top"), "count")


@query("SELECT * FROM (VALUES ('finance', 'sum', 'Volumen Total'), ('network', 'count', 'N° Paquetes / Eventos'), ('general', 'sum', 'sum'), ('sales', 'Unique', 'Unique')) AS t(template, label, shown)")
def business_aliases(spark, sf_dir):
    pairs = [("finance", "sum"), ("network", "count"), ("general", "sum"), ("sales", "Unique")]
    return _rows(spark, [(t, n, report.translate(n, t)) for t, n in pairs], "template string, label string, shown string")


@query("SELECT * FROM (VALUES (1::BIGINT, 1500.5::DOUBLE, 20240229, 'a@b.co'), (2, NULL, NULL, 'x')) AS t(employee_id, salary, hire_date, email)")
def blueprint_typed(spark, sf_dir):
    plan = Blueprint((Field("employee_id", "Integer"), Field("salary", "Currency"), Field("hire_date", "Date"), Field("email", "Email")))
    plan = Blueprint.from_json(plan.to_json())
    text = 'employee_id;salary;hire_date;email\n1;$1500.5;2024-02-29;a@b.co\n2;n/a;soon;x\n'
    return Dataset(spark, _file(spark, "hr.csv", text), blueprint=plan).frame


# --- edits --------------------------------------------------------------------------------------------------------


def _edited(spark: SparkSession) -> Dataset:
    folder = scratch(spark, "edited")
    for name in ("left", "right"):
        put(spark, f"{folder}/{name}.csv", f"id,name\n1,{name} a\n2,{name} b\n3,{name} c\n".encode())
    data = Dataset(spark, folder)
    data.delete([0, 2], file="left.csv")
    data.update({1: "20,changed"}, file="right.csv")
    data.update({2: "30,back"}, file="left.csv")
    data.delete([1], file="left.csv")
    return data


_AFTER = "SELECT * FROM (VALUES ('30', 'back'), ('1', 'right a'), ('20', 'changed'), ('3', 'right c')) AS t(id, name)"


@query(_AFTER)
def edits_in_frame(spark, sf_dir):
    return _edited(spark).frame


@query("SELECT * FROM (VALUES ('left.csv', 2::BIGINT, '30,back'), ('right.csv', 0, '1,right a'), ('right.csv', 1, '20,changed'), ('right.csv', 2, '3,right c')) AS t(file, row_idx, line)")
def edits_in_lines(spark, sf_dir):
    return _edited(spark).lines.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "row_idx", "line")


@query("SELECT * FROM (VALUES ('left.csv', 0::BIGINT, true, NULL), ('left.csv', 1, true, NULL), ('left.csv', 2, false, '30,back'), ('right.csv', 1, false, '20,changed')) AS t(file, row_idx, is_deleted, content)")
def edits_saved(spark, sf_dir):
    path, data = scratch(spark, "edits"), _edited(spark)
    data.save_edits(path)
    data.load_edits(path)  # what was read stays readable while a new version is saved over it
    data.save_edits(path)
    state = delta.Delta.load(spark, path).state()
    return state.withColumn("file", F.regexp_extract("file", "[^/]+$", 0))


@query(_AFTER)
def edits_compacted(spark, sf_dir):
    path = scratch(spark, "compacted")
    _edited(spark).compact(path)
    return spark.read.parquet(path)


@query("SELECT * FROM (VALUES (1, 'deep full 7'), (2, 'plain discovery 0'), (3, 'over basic 7'), (4, 'None')) AS t(k, shown)")
def saved_profiles(spark, sf_dir):
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the driver's own settings, as the command line keeps them
        store = ProfileStore(f"{folder}/profiles.json")
        store.save("deep", AnalysisProfile("deep", "full", skip_rows=7))
        store.save("plain", AnalysisProfile("plain"))
        shown = [store.get("deep"), store.get("plain"), store.get("deep").over(description="over", level="basic")]
        store.delete("deep")
        rows = [f"{p.description} {p.level} {p.skip_rows}" for p in shown] + [str(store.get("deep"))]
    return _rows(spark, list(enumerate(rows, 1)), "k int, shown string")


# --- extension points ---------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('alpha', 1), ('beta', 2)) AS t(name, n)")
def registered_format(spark, sf_dir):
    def read(session, paths):
        return session.read.text(paths).where("value <> '#pairs'").select(F.split_part("value", F.lit("="), F.lit(1)).alias("name"), F.split_part("value", F.lit("="), F.lit(2)).cast("int").alias("n"))

    formats.register("pairs", lambda head: head.startswith(b"#pairs"), read)
    try:
        return Dataset(spark, _file(spark, "x.txt", "#pairs\nalpha=1\nbeta=2\n")).frame
    finally:
        formats.unregister("pairs")


@query("SELECT 60 AS records, 1830::BIGINT AS ids")
def record_callback(spark, sf_dir):
    seen: list[int] = []
    n = Dataset(spark, _file(spark, "cb.evtx", samples.event_log())).each(lambda r: seen.append(int(r["record_id"])))
    return _rows(spark, [(n, sum(seen))], "records int, ids bigint")
