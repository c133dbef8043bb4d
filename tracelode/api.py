"""The facade: one object over a file or a directory tree."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blueprint import Blueprint
from .operators import delta, group, ioc, joins, profile, search, zones
from .options import ReadOptions
from .plans.predicate import select_rows
from .sources import dataset, export, files, formats


class Dataset:
    """Rows of all files under a path, with the engine's verbs.

    ``frame`` holds the parsed columns; ``lines`` the raw text lines with
    ``file`` and ``row_idx``, which counts the data rows of a file from 0.
    Edits made with ``delete`` and ``update`` show in every later read of either.
    """

    def __init__(self, spark: SparkSession, path: str, options: ReadOptions | None = None, blueprint: Blueprint | None = None):
        self.spark, self.path, self.options = spark, path, self._merged(options, blueprint)
        self.blueprint = blueprint
        self.paths = files.data_files(spark, path, self.options.full_scan)
        self._plain = self._applied(dataset.read_files(spark, self.paths, self.options))
        self._edits: delta.Delta | None = None

    @staticmethod
    def _merged(options: ReadOptions | None, blueprint: Blueprint | None) -> ReadOptions:
        """The options, and what only the blueprint says of how to read."""
        o = options or ReadOptions()
        if blueprint is None:
            return o
        return replace(
            o,
            delimiter=o.delimiter or blueprint.delimiter,
            rfc_4180=o.rfc_4180 if o.rfc_4180 is not None else blueprint.rfc_4180 or None,
            skip_rows=o.skip_rows or blueprint.skip_rows,
            strip_quotes=o.strip_quotes or blueprint.strip_quotes,
        )

    def _applied(self, df: DataFrame) -> DataFrame:
        return self.blueprint.apply(df) if self.blueprint else df

    @property
    def numbered(self) -> DataFrame:
        """The parsed columns with ``file`` and ``row_idx``, edits included."""
        raw = dataset.read_files(self.spark, self.paths, self.options, numbered=True)
        return self._applied(self._edited(raw))

    @property
    def frame(self) -> DataFrame:
        return self._plain if self._edits is None else self.numbered.select(*[f"`{c}`" for c in self._plain.columns])

    def _edited(self, raw: DataFrame) -> DataFrame:
        """``raw`` under the edits; a replaced line is parsed as the file's own are."""
        if self._edits is None:
            return raw
        cells = [c for c in raw.columns if c not in ("file", "row_idx")]
        if cells == ["line"]:
            return delta.overlay(raw, self._edits, line_col="line")
        head = dataset.head_of(self.spark, self.paths[0])
        kind = formats.detect(head, self.paths[0], self.options.forced_format)
        names = ", ".join(f"`{c}` {raw.schema[c].dataType.simpleString()}" for c in cells)
        if kind == "json":
            parsed = F.from_json("content", names)
        else:
            sep = self.options.delimiter or formats.delimiter(head) or ","
            parsed = F.from_csv("content", names, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
        edits = delta.Delta(self._edits.deletes, self._edits.updates.withColumn("content", parsed), self._edits.keys)
        return delta.overlay(raw, edits)

    @property
    def lines(self) -> DataFrame:
        """Data lines: the preamble and the header are not among them."""
        skip = self.options.skip_rows + (1 if self.options.has_header else 0)
        rows = dataset.text_lines(self.spark, self.paths, skip)
        return rows if self._edits is None else delta.overlay(rows, self._edits, line_col="line")

    def _file(self, part: str | None) -> str:
        """The URI of the first file whose path holds a text; without one the only file."""
        if part is None and len(self.paths) > 1:
            raise ValueError("several files: name the one to edit")
        for p in sorted(self.paths):
            if part is None or part in p:
                return dataset.uri_of(self.spark, p)
        raise FileNotFoundError(part)

    def _keyed(self, rows: list, file: str | None, more: str = "") -> DataFrame:
        where = self._file(file)
        return self.spark.createDataFrame([(where, *r) for r in rows], f"file string, row_idx bigint{more}")

    def delete(self, rows: list[int], file: str | None = None) -> None:
        """Delete rows of the first file whose path holds ``file``."""
        edits = self._edits or delta.Delta.empty(self.spark, by_file=True)
        self._edits = edits.delete(self._keyed([(r,) for r in rows], file))

    def update(self, rows: dict[int, str], file: str | None = None) -> None:
        """Replace rows of the first file whose path holds ``file`` by raw lines; a deleted row comes back."""
        edits = self._edits or delta.Delta.empty(self.spark, by_file=True)
        self._edits = edits.update(self._keyed(list(rows.items()), file, ", content string"))

    def save_edits(self, path: str) -> str:
        return (self._edits or delta.Delta.empty(self.spark, by_file=True)).save(path)

    def load_edits(self, path: str) -> None:
        self._edits = delta.Delta.load(self.spark, path)

    def compact(self, path: str) -> None:
        """Write the edited rows to a new place."""
        self.frame.write.mode("errorifexists").parquet(path)

    def each(self, callback: Callable[[dict], object]) -> int:
        """Call ``callback`` with every record, one partition on the driver at a time; returns how many there were."""
        n = 0
        for row in self.frame.toLocalIterator():
            callback(row.asDict(recursive=True))
            n += 1
        return n

    def metadata(self) -> DataFrame:
        return dataset.metadata(self.spark, self.paths, self.frame)

    def where(self, filter_text: str) -> DataFrame:
        return select_rows(self.frame, filter_text)

    def count(self, **predicates) -> int:
        return select_rows(self.frame, **predicates).count()

    def analyze(self, level: str = "discovery", columns: list[str] | None = None, **predicates) -> DataFrame:
        by = [self.blueprint.discriminator] if self.blueprint and self.blueprint.discriminator else []
        limits = self.blueprint.limits() if self.blueprint else None
        return profile.profile(select_rows(self.frame, **predicates), columns, level, by, limits)

    def group(self, by: int | str, agg: int | str, filter_text: str | None = None, n: int = 50, **predicates) -> DataFrame:
        return group.top_by_sum(group.group_by(select_rows(self.frame, filter_text, **predicates), by, agg), n)

    def top(self, column: int | str, n: int = 10, descending: bool = False, filter_text: str | None = None, **predicates) -> DataFrame:
        return group.top_n(select_rows(self.frame, filter_text, **predicates), column, n, descending)

    def hybrid(self, query: str, limit: int = 100) -> DataFrame:
        """(file, row_idx, offset, line): every place in a line where ``query`` occurs, without case, in order."""
        found = search.occurrences(self.lines, "line", query, ["file", "row_idx", "line"])
        return found.select("file", "row_idx", "offset", "line").orderBy("file", "row_idx", "offset").limit(limit)

    def search(self, query: str, limit: int = 100, ignore_case: bool = True) -> DataFrame:
        return search.dataset_search(self.lines, query, limit, "file", "row_idx", "line", ignore_case)

    def ioc_search(self, indicators: list[str]) -> DataFrame:
        return search.indicators(self.lines, "line", indicators, ["file", "row_idx", "line"])

    def rows(self, start: int, end: int) -> DataFrame:
        return dataset.rows_between(self.lines, start, end)

    def extract_ips(self, mode: str = "both", geo: DataFrame | None = None) -> DataFrame:
        found = ioc.extract_ips(self.lines, "line", ["file"], mode)
        return ioc.rank(ioc.frequencies(found, "file"), geo)

    def join(self, other: Dataset, left_on: str, right_on: str, how: str = "inner", **options) -> DataFrame:
        return joins.join(self.frame, other.frame, left_on, right_on, how, **options)

    def zone_map(self, columns: list[str], size: int = zones.ZONE_ROWS) -> DataFrame:
        """Of each file's rows, as ``numbered`` counts them."""
        return zones.zone_map(self.numbered, columns, size=size, by=["file"])

    def export(self, path: str, form: str = "csv", **predicates) -> None:
        {"csv": export.export_csv, "json": export.export_json}[form](self.frame, path, **predicates)

    def benchmark_search(self, query: str) -> dict:
        """Occurrences of ``query`` (without overlaps) and the rate of the scan."""
        began = time.perf_counter()
        line = F.lower("line")
        n = self.lines.agg(F.sum((F.length(line) - F.length(F.replace(line, F.lit(query.lower())))) / F.lit(len(query))), F.sum(F.octet_length("line"))).first()
        took = time.perf_counter() - began
        return {"matches": int(n[0] or 0), "seconds": took, "mb_per_s": (n[1] or 0) / 1e6 / took}


def cancellable(spark: SparkSession, tag: str):
    """Run what follows under ``tag``; ``spark.interruptTag(tag)`` from elsewhere stops it."""
    spark.addTag(tag)
    return lambda: spark.removeTag(tag)


class Daemon:
    """Requests as JSON objects, one a line: metadata, get_rows, search, exit."""

    def __init__(self, data: Dataset):
        self.data, self.open = data, True

    def handle(self, line: str) -> str:
        try:
            request = json.loads(line)
            verb = request.get("command") or request.get("method")
            if verb == "metadata":
                m = self.data.metadata().first()
                out = {"total_rows": m.total_rows, "skip_rows": self.data.options.skip_rows, "columns": list(m.columns)}
            elif verb == "get_rows":
                start, limit = int(request.get("start", 0)), min(int(request.get("limit", 100)), 500)
                out = {"rows": [r.line for r in self.data.rows(start, start + limit).collect()]}
            elif verb == "search":
                hits = search.distinct_rows(self.data.lines, "line", request.get("query", ""), "row_idx", int(request.get("limit", 1000)))
                out = {"rows": [r.row_idx for r in hits.collect()]}
            elif verb == "exit":
                self.open, out = False, {}
            else:
                raise ValueError(f"unknown command {verb!r}")
            return json.dumps({"status": "ok", **out})
        except Exception as e:  # noqa: BLE001  every request gets an answer
            return json.dumps({"status": "error", "message": str(e)})


def system_info(spark: SparkSession) -> DataFrame:
    """(property, value): what the session runs on."""
    sc = spark.sparkContext
    runtime = sc._jvm.java.lang.System
    found = {
        "master": sc.master,
        "spark": spark.version,
        "java": runtime.getProperty("java.version"),
        "os": f"{runtime.getProperty('os.name')} {runtime.getProperty('os.version')} {runtime.getProperty('os.arch')}",
        "parallelism": str(sc.defaultParallelism),
        "executors": str(sc._jsc.sc().getExecutorMemoryStatus().size()),
        "driver_memory_mb": str(sc._jvm.java.lang.Runtime.getRuntime().maxMemory() >> 20),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
    return spark.createDataFrame(sorted(found.items()), "property string, value string")
