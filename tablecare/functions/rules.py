"""Definition rules written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# A comparison with an optional guard, the guard itself, and the
# separators of a value list.
COMPARISON = r"(?i)^\s*(>=|<=|<>|>|<|=)\s*(-?\d+(?:\.\d+)?)\s*(?:when\s+(.+))?$"
GUARD = r"(?i)^(.+?)\s*(?:=|\bis\b|\bequals\b)\s*(.+)$"
LIST_SEPARATOR = r"(?i)[,;]|\bor\b"


def parse_rule(c: Column) -> Column:
    """``> 7 when Diagnosis = x`` or a value list as one struct."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    threshold = text.rlike(COMPARISON)
    guard = F.regexp_extract(text, COMPARISON, 3)
    guarded = threshold & guard.rlike(GUARD)
    values = F.filter(F.transform(F.split(text, LIST_SEPARATOR), trimmed), lambda v: v != "")
    return F.struct(
        F.when(threshold, F.lit("threshold")).otherwise(F.lit("values")).alias("kind"),
        F.when(threshold, F.regexp_extract(text, COMPARISON, 1)).alias("op"),
        F.when(threshold, F.regexp_extract(text, COMPARISON, 2).try_cast("double")).alias("value"),
        F.when(guarded, trimmed(F.regexp_extract(guard, GUARD, 1))).alias("when_column"),
        F.when(guarded, trimmed(F.regexp_extract(guard, GUARD, 2))).alias("when_value"),
        F.when(threshold, F.array().cast("array<string>")).otherwise(values).alias("values"),
    )


def term_key_expr(c: Column) -> Column:
    """The loose key of a defined term, as an expression."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "s$", "")
