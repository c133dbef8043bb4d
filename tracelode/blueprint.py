"""Schema overrides: semantic types, formulas, a grouping column and a line pattern."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.formula import with_formulas
from .functions.scalar import date_key, numeric_prefix, strict_number, unquote
from .plans.predicate import matches

# The semantic types and what carries them.
SEMANTIC = {
    "Numeric": "double",
    "Integer": "bigint",
    "Currency": "double",
    "Percentage": "double",
    "Date": "int",
    "Boolean": "boolean",
    "Category": "string",
    "IP": "string",
    "MAC": "string",
    "ID": "string",
    "Email": "string",
    "URL": "string",
    "UUID": "string",
    "PhoneNumber": "string",
    "JSON": "string",
}


@dataclass(frozen=True)
class Field:
    name: str
    semantic: str = "Category"
    format: str | None = None
    currency: str | None = None
    low: float | None = None
    high: float | None = None

    def struct_field(self) -> T.StructField:
        notes = {"semantic": self.semantic, "format": self.format, "currency": self.currency}
        kind = T._parse_datatype_string(SEMANTIC[self.semantic])
        return T.StructField(self.name, kind, True, {k: v for k, v in notes.items() if v is not None})


@dataclass(frozen=True)
class Blueprint:
    fields: tuple[Field, ...] = ()
    formulas: dict[str, str] = field(default_factory=dict)
    discriminator: str | None = None
    regex_pattern: str | None = None
    delimiter: str | None = None
    rfc_4180: bool = False
    skip_rows: int = 0
    strip_quotes: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Blueprint:
        raw = json.loads(text)
        return cls(**(raw | {"fields": tuple(Field(**f) for f in raw.get("fields", ()))}))

    def apply(self, df: DataFrame) -> DataFrame:
        """Cells read as their semantic types, tagged in the metadata; then filter and formulas."""
        if self.regex_pattern:
            df = matches(df, self.regex_pattern, self.delimiter or ",")
        names = {c.strip().lower(): c for c in df.columns}
        for f in self.fields:
            found = names.get(f.name.lower())
            if found is None:
                continue
            col, want = unquote(F.col(f"`{found}`").cast("string")), f.struct_field()
            if f.semantic in ("Currency", "Percentage"):
                typed = numeric_prefix(F.regexp_replace(col, r"^[^0-9+.-]+", ""))
            elif f.semantic == "Date":
                typed = date_key(col)
            elif f.semantic in ("Numeric", "Integer"):
                typed = strict_number(col).try_cast(SEMANTIC[f.semantic])
            elif f.semantic == "Boolean":
                typed = col.try_cast("boolean")
            else:
                typed = col
            df = df.withColumn(found, typed.alias(found, metadata=want.metadata))
        return with_formulas(df, self.formulas)

    def limits(self) -> dict[str, tuple[float, float]]:
        inf = float("inf")
        return {
            f.name: (-inf if f.low is None else f.low, inf if f.high is None else f.high)
            for f in self.fields
            if f.low is not None or f.high is not None
        }


# Columns of the presets.
PRESETS = {
    "hr": Blueprint(
        (
            Field("employee_id", "ID"),
            Field("full_name", "Category"),
            Field("email", "Email"),
            Field("salary", "Currency"),
            Field("hire_date", "Date"),
        )
    ),
    "finance": Blueprint(
        (
            Field("transaction_id", "ID"),
            Field("amount", "Currency"),
            Field("currency", "Category"),
            Field("source_account", "ID"),
            Field("destination_account", "ID"),
            Field("timestamp", "Date"),
        )
    ),
    "it_forensic": Blueprint(
        (
            Field("timestamp", "Date"),
            Field("source_ip", "IP"),
            Field("destination_ip", "IP"),
            Field("source_port", "Integer"),
            Field("protocol", "Category"),
            Field("uuid", "UUID"),
            Field("payload_json", "JSON"),
        )
    ),
}
