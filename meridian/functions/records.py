"""Column functions of records: printed epochs, fingerprints, modes of quantities, heights of two kinds, values with their sigmas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modes of a quantity, the weakest last.
MODES = ("RIGOROUS", "APPROXIMATE")


def parse_epoch(text: Column) -> Column:
    """The date of dd.mm.yyyy; null where the text is no such date."""
    return F.try_to_timestamp(F.trim(text), F.lit("dd.MM.yyyy")).cast("date")


def sp3_span(head: Column, epochs: Column) -> Column:
    """First and last epoch of an SP3 header: its first line has the start and the number of epochs, its second (`##`) the interval in
    seconds. `head` is the header's text; `epochs`, where not null, is put in place of the printed number."""
    first = r"^#[a-d][PV]\s*(\d{4})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})\s+([\d.]+)\s+(\d+)"
    part = lambda k: F.regexp_extract(head, first, k)
    start = F.make_timestamp(*(part(k).cast("int") for k in range(1, 6)), part(6).cast("double"))
    interval = F.regexp_extract(head, r"(?m)^##\s+\d+\s+[\d.]+\s+([\d.]+)", 1).cast("double")
    seconds = (F.coalesce(epochs, part(7).cast("int")) - 1) * interval
    last = F.timestamp_micros(F.unix_micros(start) + (seconds * 1e6).cast("long"))
    return F.when(F.rlike(head, F.lit(first)), F.struct(start.alias("first"), last.alias("last")))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON, in the order of their names, nulls left out."""
    return F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items())))), 256)


def combined_mode(*modes: Column) -> Column:
    """The weakest of the modes."""
    rank = [F.array_position(F.array(*map(F.lit, MODES)), m) for m in modes]
    return F.array(*map(F.lit, MODES))[(F.greatest(*rank) if len(rank) > 1 else rank[0]).cast("int") - 1]


def combined_strategies(*strategies: Column) -> Column:
    """All strategies of the operands, each once, in order."""
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(s, F.array().cast("array<string>")) for s in strategies))))


def combined_height(value: Column, variance: Column, kind: Column, target: str, undulation: Column, undulation_variance: Column) -> tuple[Column, Column]:
    """A height and its variance in the target's system, `orthometric` or `ellipsoidal`. Raises where the two differ and there is no
    undulation, or either is of another kind."""
    sign = -1.0 if target == "orthometric" else 1.0
    known = kind.isin("orthometric", "ellipsoidal") & F.lit(target in ("orthometric", "ellipsoidal")) & undulation.isNotNull()
    refused = F.raise_error(F.concat(F.lit(f"no way to a height of type {target} from "), kind)).cast("double")
    height = F.when(kind == target, value).when(known, value + sign * undulation).otherwise(refused)
    return height, F.when(kind == target, variance).otherwise(variance + F.coalesce(undulation_variance, F.lit(0.0)))


def displayed(value: Column, sigma: Column, digits: int = 4) -> Column:
    """A value with its sigma as text."""
    return F.concat(F.format_number(value, digits), F.when(sigma.isNotNull(), F.concat(F.lit(" ± "), F.format_number(sigma, digits))).otherwise(F.lit("")))
