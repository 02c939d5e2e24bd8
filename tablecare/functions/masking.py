"""Look-alike values: same length, character classes and layout, other content."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import ISO_DATE


def _draw(seed: Column, salt: Column | int, n: int) -> Column:
    salt = F.lit(salt) if isinstance(salt, int) else salt
    return F.pmod(F.xxhash64(seed, salt), F.lit(n)).cast("int")


def _pick(alphabet: str, draw: Column) -> Column:
    return F.substring(F.lit(alphabet), draw + 1, F.lit(1))


def mask_text(c: Column, seed: Column) -> Column:
    """Replace each letter and digit by another of its class.

    ``seed`` must identify the row and the column and never the value, so equal
    values get unrelated masks.
    """
    def one(ch: Column, i: Column) -> Column:
        return (
            F.when(ch.rlike("[a-z]"), _pick(string.ascii_lowercase, _draw(seed, i, 26)))
            .when(ch.rlike("[A-Z]"), _pick(string.ascii_uppercase, _draw(seed, i, 26)))
            .when(ch.rlike("[0-9]"), _draw(seed, i, 10).cast("string"))
            .otherwise(ch)
        )

    return F.array_join(F.transform(F.split(c, ""), one), "")


def mask_date_text(c: Column, seed: Column) -> Column:
    """Another ISO date, with a time part only where the value has one."""
    day = F.format_string(
        "%04d-%02d-%02d", _draw(seed, 1, 19) + 2001, _draw(seed, 2, 12) + 1, _draw(seed, 3, 28) + 1
    )
    time = F.format_string(" %02d:%02d", _draw(seed, 4, 24), _draw(seed, 5, 60))
    return F.concat(day, F.when(c.rlike(r"\s\d{2}:\d{2}$"), time).otherwise(F.lit("")))


def mask_string(c: Column, seed: Column) -> Column:
    return F.when(c.rlike(ISO_DATE), mask_date_text(c, seed)).otherwise(mask_text(c, seed))


def mask_number_text(c: Column, seed: Column) -> Column:
    """Keep sign and digit counts; a leading digit of several stays non-zero."""
    def one(ch: Column, i: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).otherwise(ch)

    masked = F.array_join(F.transform(F.split(c, ""), one), "")
    first = (_draw(seed, -1, 9) + 1).cast("string")
    return F.when(
        c.rlike(r"^-?\d\d"), F.concat(F.regexp_extract(c, "^-?", 0), first, F.regexp_replace(masked, r"^-?\d", ""))
    ).otherwise(masked)
