"""Applying chosen fixes, the removed rows and the cleaning log (Q17-Q19)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.names import name_key
from ..functions.numbers import censored, epoch_serial, number_text, strip_unit
from ..functions.text import blank_markers, merge_spellings, quoted
from .cells import blank_of
from .provenance import Trail

# Which finding types a request word selects.
REQUEST_TYPES = {
    "duplicates": ["duplicateRows", "duplicateIds", "duplicateEncounterIds", "duplicatePatientIds"],
    "dates": ["textDates", "epochDates"],
    "missing": ["missing"],
    "variants": ["categoryVariants"],
}

CELL_FIXES = {
    "number_text": lambda c, p: number_text(c),
    "blank_markers": lambda c, p: blank_markers(c),
    "parse_date": lambda c, p: parse_date(c, p.get("order", "MDY")),
    "merge_spellings": lambda c, p: merge_spellings(c, p.get("map", {})),
    "censored": lambda c, p: censored(c, p.get("policy", "boundary")),
    "epoch_serial": lambda c, p: epoch_serial(c),
    "strip_unit": lambda c, p: strip_unit(c),
}
ROW_FIXES = ["dedupe_rows", "dedupe_encounters", "keep_one", "split_rows"]


@dataclass(frozen=True)
class Fix:
    """One chosen fix: what to do, on which column, with which parameters."""

    name: str
    column: str | None = None
    params: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return self.name if self.column is None else f"{self.name}({self.column})"

    def on(self, c: Column) -> Column:
        return CELL_FIXES[self.name](c, self.params)

    def to_json(self) -> dict:
        return {"name": self.name, "column": self.column, "params": self.params}


@dataclass(frozen=True)
class Fixed:
    rows: DataFrame
    removed: DataFrame
    log: DataFrame


def in_order(fixes: list[Fix]) -> list[Fix]:
    """Cell fixes first, then the row fixes in their fixed order; one of each but splits."""
    unknown = [f.name for f in fixes if f.name not in CELL_FIXES and f.name not in ROW_FIXES]
    if unknown:
        raise ValueError(f"unknown fixes {unknown}")
    out = [f for f in fixes if f.name in CELL_FIXES]
    for name in ROW_FIXES:
        chosen = [f for f in fixes if f.name == name]
        out += chosen if name == "split_rows" else chosen[:1]
    return out


def apply_cells(df: DataFrame, fixes: list[Fix]) -> DataFrame:
    """All cell fixes in one projection, in order per column."""
    final = {c: reduce(lambda v, f: f.on(v), [f for f in fixes if f.column == c], quoted(c)) for c in df.columns}
    return df.select(*[v.alias(c) for c, v in final.items()])


def follow(trail: Trail, fix: Fix) -> int:
    """Add one fix to a trail; its step number there."""
    if fix.name in CELL_FIXES:
        return trail.cell(fix.label, fix.column, fix.on)
    if fix.name == "split_rows":
        return trail.split(fix.label, fix.column)
    if fix.name == "dedupe_rows":
        return trail.copies(fix.label)
    if fix.name == "dedupe_encounters":
        return trail.copies(fix.label, ~blank_of(trail.table, fix.column))
    return trail.survivors(fix.label, fix.column, fix.params.get("policy", "firstrow"))


def apply_fixes(df: DataFrame, fixes: list[Fix], order_by) -> Fixed:
    """Run the chosen fixes once; rows, removed rows and the log all read the stored trail (Q17, Q18)."""
    trail = Trail(df, order_by)
    for fix in in_order(fixes):
        follow(trail, fix)
    done = trail.store()
    log = done.steps().select("step", F.col("label").alias("action"), "cells_changed", "rows_before", "rows_after")
    return Fixed(done.rows, done.removed, log)


def select_findings(findings: DataFrame, request: str, column: str | None = None) -> DataFrame:
    """Findings a request word and an optional column name select (Q19).

    The caller sees every candidate; more than one means the request is ambiguous.
    """
    wanted = findings.filter(F.col("type").isin(*REQUEST_TYPES[request]))
    if column:
        key = F.regexp_replace(F.lower("column"), "[^a-z0-9]", "")
        wanted = wanted.filter(key == name_key(column))
    return wanted
