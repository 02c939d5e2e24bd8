"""Durations: quantities in words and columns whose name states a unit."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import plain_number
from .numbers import round2

# Number words, unit words with their size in days, and the name
# patterns that state or suggest a duration.
NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12,
}
UNIT_NAMES = {
    "day": "days", "days": "days", "week": "weeks", "weeks": "weeks",
    "hour": "hours", "hours": "hours", "hr": "hours", "hrs": "hours",
    "month": "months", "months": "months",
}
DAYS_PER = {"days": 1.0, "weeks": 7.0, "hours": 1.0 / 24, "months": 30.0}
DAY_NAME = re.compile(r"(^|[_\s-])days?($|[_\s-])", re.I)
HOUR_NAME = re.compile(r"(^|[_\s-])h(ou)?rs?($|[_\s-])", re.I)
DURATION_NAME = re.compile(r"duration|length.?of.?stay|\blos\b|wait.?time|time.?to|\bstay\b", re.I)

QUANTITY = (
    r"(?i)\b(" + "|".join(NUMBER_WORDS) + r"|\d+(?:\.\d+)?)\s+(" + "|".join(UNIT_NAMES) + r")\b"
)


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def parse_quantity(c: Column) -> Column:
    """``"two weeks"`` to struct(number, unit, word, days, approximate) (F16)."""
    word = F.lower(F.regexp_extract(c, QUANTITY, 1))
    unit_word = F.lower(F.regexp_extract(c, QUANTITY, 2))
    number = F.coalesce(
        F.try_element_at(_literal_map({k: float(v) for k, v in NUMBER_WORDS.items()}), word),
        word.try_cast("double"),
    )
    unit = F.try_element_at(_literal_map(UNIT_NAMES), unit_word)
    days = number * F.try_element_at(_literal_map(DAYS_PER), unit)
    return F.when(
        unit.isNotNull() & number.isNotNull(),
        F.struct(
            number.alias("number"), unit.alias("unit"), unit_word.alias("word"),
            days.alias("days"), (unit == "months").alias("approximate"),
        ),
    )


def column_unit(name: str) -> str | None:
    """The unit a column name states: days, hours or none."""
    if DAY_NAME.search(name):
        return "days"
    return "hours" if HOUR_NAME.search(name) else None


def is_duration_name(name: str) -> bool:
    return column_unit(name) is not None or bool(DURATION_NAME.search(name))


def quantity_in_column_unit(quantity: Column, column: str) -> Column:
    """F16's struct as a number in the unit ``column`` states; null if it states none."""
    unit = column_unit(column)
    if unit is None:
        return F.lit(None).cast("double")
    per_day = 24.0 if unit == "hours" else 1.0
    return round2(quantity["days"] * F.lit(per_day))


def duration_label(value: Column, column: str) -> Column:
    """``10`` in ``Duration_days`` to ``"10 days"``."""
    unit = column_unit(column)
    text = plain_number(value)
    return F.coalesce(F.concat(text, F.lit(f" {unit}")) if unit else text, F.lit(""))


def unit_note(column: str) -> str | None:
    """A note for a column that looks like a duration but names no unit."""
    if column_unit(column) is None and is_duration_name(column):
        return f"{column} looks like a duration but states no unit"
    return None
