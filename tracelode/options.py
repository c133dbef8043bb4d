"""Options of a dataset and of an analysis, and saved named profiles of them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class ReadOptions:
    """How files are read.

    ``strip_quotes`` takes one pair of outer quotes off cells; ``infer`` reads
    text cells as the types that the first values of their columns spell.

    ``hardware_mode``, ``gpu``, ``threads``, ``chunk_size_mb`` and ``no_limit``
    are accepted and change nothing: Spark places the work.
    """

    delimiter: str | None = None
    has_header: bool = True
    rfc_4180: bool | None = None
    strip_quotes: bool = False
    infer: bool = False
    skip_rows: int = 0
    forced_format: str | None = None
    full_scan: bool = False
    multi_line: bool = False
    no_index: bool = False
    hardware_mode: str = "auto"
    gpu: bool = False
    threads: int | None = None
    chunk_size_mb: int | None = None
    no_limit: bool = False


@dataclass(frozen=True)
class AnalysisProfile:
    """A named set of analysis options."""

    description: str | None = None
    level: str = "discovery"
    target_columns: list[str] = field(default_factory=list)
    filter: str | None = None
    regex_pattern: str | None = None
    delimiter: str | None = None
    skip_rows: int = 0
    enable_network: bool = False
    business_template: str = "general"

    def over(self, **given) -> AnalysisProfile:
        """The profile under options given on the command line, which win."""
        names = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in given.items() if v is not None and k in names})


class ProfileStore:
    """Named profiles in a JSON file on the driver."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def _all(self) -> dict[str, dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def _write(self, profiles: dict[str, dict]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(profiles, indent=2, sort_keys=True))
        part.replace(self.path)

    def save(self, name: str, profile: AnalysisProfile) -> None:
        self._write(self._all() | {name: asdict(profile)})

    def get(self, name: str) -> AnalysisProfile | None:
        found = self._all().get(name)
        return AnalysisProfile(**found) if found is not None else None

    def list(self) -> list[tuple[str, str | None]]:
        return [(n, p.get("description")) for n, p in sorted(self._all().items())]

    def delete(self, name: str) -> bool:
        profiles = self._all()
        found = profiles.pop(name, None) is not None
        if found:
            self._write(profiles)
        return found
