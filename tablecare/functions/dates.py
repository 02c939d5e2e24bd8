"""Calendar text: declared-order dates, period labels, ordering keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, trimmed

# The accepted date shapes and the month prefixes.
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(\s+\d{2}:\d{2})?$"
SLASH_DATE = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
YEAR_MONTH = r"^(\d{4})-(\d{2})"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
TIME_LIKE = r"(?i)^(\d{4}([-/]\d{1,2})?|" + "|".join(MONTHS) + r"|q[1-4])"


def slash_parts(c: Column) -> tuple[Column, Column, Column]:
    """The three numbers of a cell that has the shape of a slash date; anything for other cells."""
    parts = F.split(trimmed(c), "[/-]")
    return tuple(F.get(parts, F.lit(i)).try_cast("int") for i in range(3))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where no such day exists.

    Counted from the first of the month, so nothing has to fail to be refused.
    """
    first = F.when(month.between(1, 12) & (year >= 1), F.make_date(year, month, F.lit(1)))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def is_calendar_date(year: Column, month: Column, day: Column) -> Column:
    return calendar_date(year, month, day).isNotNull()


def slash_date(c: Column, order: str) -> Column:
    """The date a d/m/y or m/d/y cell means under ``order``, else null."""
    a, b, year = slash_parts(c)
    month, day = (b, a) if order == "DMY" else (a, b)
    return F.when(trimmed(c).rlike(SLASH_DATE), calendar_date(year, month, day))


def parse_date(c: Column, order: str = "MDY") -> Column:
    """Rewrite d/m/y or m/d/y text as ISO text, leaving what it cannot read (F8)."""
    t = trimmed(c)
    return F.when(t.rlike(ISO_PREFIX), t).otherwise(F.coalesce(slash_date(c, order).cast("string"), c))


def period_label(c: Column, granularity: str) -> Column:
    """ISO text to ``YYYY-MM`` or ``YYYY-Qn``; unreadable gives null."""
    t = trimmed(c)
    year, month = F.regexp_extract(t, YEAR_MONTH, 1), F.regexp_extract(t, YEAR_MONTH, 2)
    if granularity == "quarter":
        label = F.concat(year, F.lit("-Q"), F.ceil(month.try_cast("int") / 3).cast("string"))
    else:
        label = F.concat_ws("-", year, month)
    return F.when(t.rlike(YEAR_MONTH), label)


def period_label_typed(c: Column, granularity: str) -> Column:
    """The same label for a real date or timestamp column."""
    if granularity == "quarter":
        return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
    return F.date_format(c, "yyyy-MM")


# Label forms, each with the groups that hold its year, quarter, month and day (0: none).
LABEL_FORMS = [
    (r"^(\d{4})\D*q([1-4])$", 1, 2, 0, 0),
    (r"^q([1-4])\D*(\d{4})$", 2, 1, 0, 0),
    (r"^(\d{4})$", 1, 0, 0, 0),
    (r"^(\d{4})[-/](\d{1,2})$", 1, 0, 2, 0),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 1, 0, 2, 3),
]


def time_order(label: Column) -> Column:
    """The first day a time label means, null for other text.

    Months by name may stand without a year; they then sort inside year 1.
    """
    t = F.lower(trimmed(label))

    def part(pattern: str, group: int, absent: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int") if group else F.lit(absent)

    read = []
    for pattern, year, quarter, month, day in LABEL_FORMS:
        first_month = (part(pattern, quarter, 1) - 1) * 3 + 1 if quarter else part(pattern, month, 1)
        read.append(F.when(t.rlike(pattern), calendar_date(part(pattern, year, 1), first_month, part(pattern, day, 1))))
    named = r"^(" + "|".join(MONTHS) + r")[a-z]*\D*(\d{4})?$"
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(t, named, 1)).cast("int")
    read.append(calendar_date(F.coalesce(part(named, 2, 1), F.lit(1)), number, F.lit(1)))
    return F.coalesce(*read)


def looks_like_time(label: Column) -> Column:
    return trimmed(label).rlike(TIME_LIKE)


def row_rank(c: Column) -> Column:
    """Number or date text as one orderable double; unreadable gives null."""
    t = trimmed(c)
    moment = F.unix_micros(F.try_to_timestamp(t)).cast("double")
    return F.when(~is_blank(c), F.coalesce(t.try_cast("double"), moment))
