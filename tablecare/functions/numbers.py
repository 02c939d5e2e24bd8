"""Numbers in text: readable values, censored results, unit words, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MAYBE_WS, WHITESPACE, WS, WS_CHARS, trimmed

# The shapes of a number, of a number with a unit word, and of a
# result outside a measuring range.
NUMBER = r"^-?\d+(\.\d+)?$"
NUMBER_GLUED_UNIT = r"^(-?\d+(?:\.\d+)?)" + WS + r"*[A-Za-z]+\.?$"
NUMBER_UNIT = r"^(-?\d+(?:\.\d+)?)" + WS + r"+([A-Za-z]+)\.?$"
LIMIT = r"^([<>]=?)" + WS + r"*(-?\d+(\.\d+)?)$"
LIMIT_LOOSE = r"^(?:[<>]=?|</=|>/=)" + WS + r"*-?\d"
NOT_DONE = r"(?i)^(pending|tnp|not done|nd)$"
EPOCH_DATE = r"^(1899|1900)-(\d{2})-(\d{2})$"
MONEY_NOISE = "[$," + WS_CHARS + "]"


def without_noise(c: Column) -> Column:
    return F.when(c.rlike(f"[$, {MAYBE_WS}]"), F.translate(c, "$," + WHITESPACE, "")).otherwise(c)


def is_number_text(c: Column) -> Column:
    return F.coalesce(without_noise(c).rlike(NUMBER), F.lit(False))


def to_number(c: Column) -> Column:
    """The readable number of a text cell, or null.

    A cell that is a clean number already, the common case, is only cast, and a
    cell without a digit is never read further.
    """
    unit = F.regexp_extract(F.btrim(c, F.lit(WHITESPACE)), NUMBER_GLUED_UNIT, 1)
    clean = F.when(unit != "", unit).otherwise(without_noise(c))
    read = F.when(clean.rlike(NUMBER), clean.try_cast("double"))
    return F.when(c.rlike(NUMBER), c.try_cast("double")).when(c.rlike("[0-9]"), read)


def number_text(c: Column) -> Column:
    """``"$1,200"`` to ``"1200"``; anything that is no number is unchanged."""
    clean = without_noise(c)
    return F.when(clean.rlike(NUMBER), clean).otherwise(c)


def censored(c: Column, policy: str = "boundary") -> Column:
    """``<0.5`` and ``pending`` by policy: boundary, missing or exclude."""
    if policy == "exclude":
        return c
    t = trimmed(c)
    limited = t.rlike(LIMIT)
    if policy == "missing":
        return F.when(~F.coalesce(limited | t.rlike(NOT_DONE), F.lit(False)), c)
    if policy == "boundary":
        return F.when(limited, F.regexp_extract(t, LIMIT, 2)).otherwise(c)
    raise ValueError(f"unknown policy {policy!r}")


def strip_unit(c: Column) -> Column:
    """``"5 Days"`` to ``"5"``."""
    n = F.regexp_extract(trimmed(c), NUMBER_UNIT, 1)
    return F.when(n != "", n).otherwise(c)


def epoch_serial(c: Column) -> Column:
    """A number mis-typed as an 1899/1900 date back to its day count."""
    part = lambda i: F.regexp_extract(c, EPOCH_DATE, i).try_cast("int")
    first = F.add_months(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1)
    days = F.date_diff(F.date_add(first, part(3) - 1), F.lit("1899-12-30").cast("date"))
    return F.when(c.rlike(EPOCH_DATE), days.cast("string")).otherwise(c)


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves toward positive infinity, unlike SQL ``round``."""
    scale = 10**digits
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale) if digits else F.floor(x + F.lit(0.5))


def round2(x: Column) -> Column:
    return half_up(x, 2)


def share(part: Column, whole: Column) -> Column:
    """Percent with one decimal; a zero denominator gives 0."""
    ratio = part.cast("double") / F.when(whole != 0, whole).cast("double")
    return F.coalesce(F.floor(ratio * 1000 + F.lit(0.5)) / F.lit(10), F.lit(0.0))
