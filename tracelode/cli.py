"""Command line: python -m tracelode.cli VERB PATH ..."""

from __future__ import annotations

import argparse
import sys
import time

from .api import Daemon, Dataset, system_info
from .blueprint import PRESETS, Blueprint
from .operators import history, search, zones
from .options import AnalysisProfile, ProfileStore, ReadOptions
from .session import session
from .sources import dataset, evtx, export, files, pcap


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracelode", description="Evidence and log analytics on Spark")
    top.add_argument("--master", default=None)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *options: tuple, path: bool = True) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        if path:
            p.add_argument("path")
        for flags, kw in options:
            p.add_argument(*flags, **kw)
        p.add_argument("--delimiter")
        p.add_argument("--skip-rows", type=int, default=0)
        p.add_argument("--no-header", action="store_true")
        p.add_argument("--full-scan", action="store_true")
        p.add_argument("--format", dest="forced_format")
        for ignored in ("--gpu", "--no-limit"):
            p.add_argument(ignored, action="store_true")
        p.add_argument("--hardware-mode", default="auto")
        return p

    number = {"type": int}
    filters = ((("--filter",), {}), (("--regex",), {}))
    verb("analyze", (("--level",), {"choices": ("basic", "discovery", "full")}), (("--blueprint",), {}), (("--profile",), {}), (("--history",), {}), *filters)
    verb("view", (("--start",), number | {"default": 0}), (("--count",), number | {"default": 20}))
    verb("search", (("query",), {}), (("--limit",), number | {"default": 100}), (("--json",), {"action": "store_true"}), (("--case-sensitive",), {"action": "store_true"}))
    verb("ioc-search", (("list",), {}), (("--comments",), {"action": "store_true"}))
    verb("group", (("--by",), number | {"required": True}), (("--agg",), number | {"required": True}), *filters)
    verb("top", (("--col",), number | {"required": True}), (("--limit",), number | {"default": 10}), (("--desc",), {"action": "store_true"}), *filters)
    verb("export", (("output",), {}), (("--as",), {"dest": "form", "choices": ("csv", "json"), "default": "csv"}), *filters)
    verb("ips", (("--mode",), {"choices": ("v4", "v6", "both"), "default": "both"}), (("--output",), {}))
    verb("join", (("other",), {}), (("--left",), {"required": True}), (("--right",), {"required": True}), (("--how",), {"default": "inner"}))
    verb("build-zones", (("output",), {}), (("--columns",), {"required": True}), (("--zone-size",), number | {"default": zones.ZONE_ROWS}))
    verb("hybrid", (("query",), {}), (("--limit",), number | {"default": 100}))
    verb("get-rows", (("--start",), number | {"required": True}), (("--limit",), number | {"required": True}))
    verb("sys-info", path=False)
    verb("scan-hardware", path=False)
    verb("index")
    verb("hash")
    verb("find", (("query",), {}), (("--limit",), number | {"default": 100}))
    verb("metadata")
    verb("pcap")
    verb("evtx", (("--carve",), {"action": "store_true"}))
    verb("bench", (("query",), {}))
    verb("daemon")
    verb("history", (("--source",), {"default": ""}))
    p = verbs.add_parser("config")
    p.add_argument("store")
    p.add_argument("action", choices=("list", "show", "save", "delete"))
    p.add_argument("name", nargs="?")
    p.add_argument("--level")
    p.add_argument("--description")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "config":
        store = ProfileStore(a.store)
        if a.action == "save":
            store.save(a.name, AnalysisProfile().over(level=a.level, description=a.description))
        elif a.action == "delete":
            return 0 if store.delete(a.name) else 1
        print(store.list() if a.action == "list" else store.get(a.name) if a.name else "")
        return 0
    spark = session(a.master)
    options = ReadOptions(a.delimiter, not a.no_header, skip_rows=a.skip_rows, full_scan=a.full_scan, forced_format=a.forced_format)
    simple = {
        "find": lambda: files.find_files(spark, a.path, a.query, limit=a.limit),
        "pcap": lambda: pcap.summarise(pcap.read_packets(spark, a.path)),
        "evtx": lambda: evtx.summarise(evtx.read_records(spark, a.path, a.carve)),
        "hash": lambda: export.block_hashes(spark, a.path),
        "history": lambda: history.scans(spark, a.path, a.source),
        "sys-info": lambda: system_info(spark),
        "scan-hardware": lambda: system_info(spark),
        "index": lambda: export.row_index(dataset.text_lines(spark, files.data_files(spark, a.path, a.full_scan))),
    }
    if a.verb in simple:
        simple[a.verb]().show(1000, truncate=False)
        return 0
    blueprint = None
    if getattr(a, "blueprint", None):
        blueprint = PRESETS.get(a.blueprint) or Blueprint.from_json("".join(r.value for r in spark.read.text(a.blueprint).collect()))
    data = Dataset(spark, a.path, options, blueprint)
    picks = {"filter_text": getattr(a, "filter", None), "regex": getattr(a, "regex", None)}
    if a.verb == "analyze":
        began = time.perf_counter()
        saved = ProfileStore(a.profile).get("default") if a.profile else None
        level = (saved or AnalysisProfile()).over(level=a.level).level
        out = data.analyze(level, **picks)
        if a.history:
            history.record(out, a.history, a.path)
            m = data.metadata().first()
            history.log_telemetry(spark, a.history + "-telemetry", a.path, int(m.total_mib * 2**20), m.total_rows, time.perf_counter() - began)
    elif a.verb == "daemon":
        daemon = Daemon(data)
        for line in sys.stdin:
            print(daemon.handle(line), flush=True)
            if not daemon.open:
                break
        return 0
    elif a.verb == "bench":
        print(data.benchmark_search(a.query))
        return 0
    elif a.verb == "export":
        data.export(a.output, a.form, **picks)
        return 0
    elif a.verb == "build-zones":
        zones.save(data.zone_map(a.columns.split(","), a.zone_size), a.output)
        return 0
    elif a.verb == "ioc-search":
        out = data.ioc_search(search.indicator_list([r.value for r in spark.read.text(a.list).collect()], a.comments))
    elif a.verb == "ips":
        out = data.extract_ips(a.mode)
        if a.output:
            export.export_ip_report(out, a.output)
    else:
        out = {
            "view": lambda: data.rows(a.start, a.start + a.count),
            "search": lambda: data.search(a.query, a.limit, not a.case_sensitive),
            "get-rows": lambda: data.rows(a.start, a.start + a.limit),
            "hybrid": lambda: data.hybrid(a.query, a.limit),
            "group": lambda: data.group(a.by, a.agg, a.filter, regex=a.regex),
            "top": lambda: data.top(a.col, a.limit, a.desc, a.filter, regex=a.regex),
            "join": lambda: data.join(Dataset(spark, a.other, options), a.left, a.right, a.how),
            "metadata": lambda: data.metadata(),
        }[a.verb]()
    if getattr(a, "json", False):
        print(export.json_array(out, a.limit))
    else:
        out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
