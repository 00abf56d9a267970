"""Declarative mappings from a file's text columns to typed fields, as native columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.angles import parse_angle
from meridian.functions.units import FACTORS, dimension_of

#: Header names by which a field is guessed.
GUESSES = {
    "station": ("station", "from", "at", "setup point"),
    "target": ("target", "to", "point", "sighted"),
    "setup": ("setup", "setup_id"),
    "face": ("face", "pos", "position"),
    "horizontal": ("horizontal", "hz", "direction"),
    "zenith": ("zenith", "v", "vertical"),
    "distance": ("distance", "d", "slope distance"),
    "reading": ("reading", "staff"),
    "sight": ("sight", "kind"),
    "line": ("line",),
}


def parse_number(text: Column, decimal: str = "auto", factor: float = 1.0) -> Column:
    """A number to SI: a decimal comma is read where `decimal` says so, or where the text has no point; there is no thousands mark.
    Null for text that is no number."""
    t = F.trim(text)
    plain = F.regexp_replace(t, ",", ".") if decimal == "," else t if decimal == "." else F.when(t.contains("."), t).otherwise(F.regexp_replace(t, ",", "."))
    return plain.try_cast("double") * factor


@dataclass(frozen=True)
class Field:
    """Where a field comes from: a column or a constant, and how its text is read."""

    column: str | None = None
    constant: str | None = None
    kind: str = "text"  # text, number or angle
    unit: str | None = None
    values: dict[str, str] = field(default_factory=dict)

    def read(self, decimal: str) -> Column:
        text = F.lit(self.constant) if self.column is None else F.col(f"`{self.column}`")
        if self.values:
            pairs = F.create_map(*(F.lit(x) for k, v in self.values.items() for x in (k, v)))
            text = F.coalesce(F.try_element_at(pairs, F.trim(text)), text)
        if self.kind == "number":
            factor = FACTORS[dimension_of(self.unit)][self.unit] if self.unit else 1.0
            return parse_number(text, decimal, factor)
        if self.kind == "angle":
            return parse_angle(text, self.unit or "degree")
        return F.when(F.trim(text) != "", F.trim(text))


@dataclass(frozen=True)
class Mapping:
    fields: dict[str, Field]
    required: tuple[str, ...] = ()
    decimal: str = "auto"

    def apply(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(good rows, findings). A row that lacks a required field, or whose text can't be read, is a finding with its row number
        and the names of the fields; it never fails the read."""
        typed = rows.select("row", *(f.read(self.decimal).alias(n) for n, f in self.fields.items()), *(F.col(f"`{f.column}`").alias(f"_raw_{n}") for n, f in self.fields.items() if f.column))
        wrong = []
        for n, f in self.fields.items():
            unread = (F.trim(F.coalesce(F.col(f"_raw_{n}"), F.lit(""))) != "") & F.col(n).isNull() if f.column else F.lit(False)
            missing = F.col(n).isNull() if n in self.required else F.lit(False)
            wrong.append(F.when(unread | missing, F.lit(n)))
        typed = typed.withColumn("_wrong", F.array_compact(F.array(*wrong)))
        good = typed.where(F.size("_wrong") == 0).select("row", *self.fields)
        findings = typed.where(F.size("_wrong") > 0).select("row", F.lit("UNREADABLE_ROW").alias("code"), F.lit("BLOCKING").alias("severity"), F.col("_wrong").alias("fields"))
        return good, findings


def infer(header: list[str], kinds: dict[str, str] | None = None) -> Mapping:
    """Guesses a mapping from header names."""
    names = {h.strip().lower(): h for h in header}
    kinds = kinds or {"horizontal": "angle", "zenith": "angle", "distance": "number", "reading": "number"}
    found = {f: next((names[g] for g in guesses if g in names), None) for f, guesses in GUESSES.items()}
    return Mapping({f: Field(column=c, kind=kinds.get(f, "text")) for f, c in found.items() if c})
