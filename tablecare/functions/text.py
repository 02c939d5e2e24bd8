"""Comparison keys, missing-value tests and simple cell rewrites."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space, and the markers that
# stand for "no value".
SPACE_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
WHITESPACE = "".join(map(chr, SPACE_CODES))
WS_CHARS = "".join(f"\\x{{{code:x}}}" for code in SPACE_CODES)
WS = "[" + WS_CHARS + "]"
NOT_WS = "[^" + WS_CHARS + "]"
# Quick looks that say whether a cell needs the exact rule at all: white space of
# Latin-1, or any character wide enough to be another kind of space.
MAYBE_WS = "\\x09-\\x0D\\xA0\\x{1680}-\\x{FFFF}"
MAYBE_AT_EDGE = f"^[ {MAYBE_WS}]|[ {MAYBE_WS}]\\z"
MAYBE_TO_COLLAPSE = f"  |[{MAYBE_WS}]"
MISSING_MARKERS = ["n/a", "na", "none", "-", "."]


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def trimmed(c: Column) -> Column:
    """Without white space at both ends; most cells have none and are only looked at."""
    t = c.cast("string")
    return F.when(t.rlike(MAYBE_AT_EDGE), F.btrim(t, F.lit(WHITESPACE))).otherwise(t)


def fold_key(c: Column) -> Column:
    """Trim, lower-case, and collapse runs of white space (F1)."""
    low = F.lower(trimmed(c))
    return F.when(low.rlike(MAYBE_TO_COLLAPSE), F.regexp_replace(low, WS + "+", " ")).otherwise(low)


def entity_key(c: Column) -> Column:
    """Trim and lower-case only: the key that row survival (W1) groups on."""
    return F.lower(trimmed(c))


def column_key(c: Column) -> Column:
    """Lower-case, keep only a-z and 0-9 (F2)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.cast("string").rlike(NOT_WS), F.lit(True))


def is_missing(c: Column) -> Column:
    """Blank or a missing-value marker."""
    return F.coalesce(F.lower(trimmed(c)).isin("", *MISSING_MARKERS), F.lit(True))


def is_marker(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin(*MISSING_MARKERS), F.lit(False))


def blank_markers(c: Column) -> Column:
    """Missing-value markers and blanks become null, the rest is unchanged."""
    return F.when(~is_missing(c), c)


def merge_spellings(c: Column, mapping: dict[str, str]) -> Column:
    """Replace the spellings named in ``mapping``."""
    if not mapping:
        return c
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(lookup, c), c)


def split_list(c: Column) -> Column:
    """``"a, b; c"`` to an array of its parts; no part at all gives ``[null]``."""
    parts = F.filter(F.transform(F.split(c, "[;,]"), trimmed), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(None).cast("string")))
