"""Report text over numbers that were already computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up, share


def plain_number(x: Column) -> Column:
    """A number as people write it: ``6`` and not ``6.0``, never an exponent."""
    d = x.cast("double")
    wide = F.regexp_replace(d.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    whole = d == F.floor(d)
    return F.when(whole, d.cast("decimal(38,0)").cast("string")).when(
        (F.abs(d) < 1e7) & (F.abs(d) >= 1e-3), d.cast("string")
    ).otherwise(wide)


def grouped_number(x: Column) -> Column:
    """Thousands separators and at most two decimals."""
    return F.regexp_replace(F.format_number(half_up(x.cast("double"), 2), 2), r"\.?0+$", "")


def mean_sd(mean: Column, sd: Column) -> Column:
    spread = F.when(sd.isNull(), F.lit("SD not available — fewer than 2 readable numbers")).otherwise(
        F.concat(F.lit("SD "), plain_number(sd))
    )
    return F.when(mean.isNull(), F.lit("no readable numbers")).otherwise(
        F.concat(plain_number(mean), F.lit(" ("), spread, F.lit(")"))
    )


def median_iqr(median: Column, q1: Column, q3: Column) -> Column:
    spread = F.when(q1.isNull() | q3.isNull(), F.lit("IQR not available")).otherwise(
        F.concat(F.lit("IQR "), plain_number(q1), F.lit("–"), plain_number(q3))
    )
    return F.when(median.isNull(), F.lit("no readable numbers")).otherwise(
        F.concat(plain_number(median), F.lit(" ("), spread, F.lit(")"))
    )


def n_percent(n: Column, total: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" ("), plain_number(share(n, total)), F.lit("%)"))


def bar_label(n: Column, total: Column) -> Column:
    """``1,240 (34%)``; the bare number where there is no denominator."""
    percent = half_up(n.cast("double") / F.when(total > 0, total).cast("double") * 100).cast("string")
    return F.coalesce(
        F.concat(grouped_number(n), F.lit(" ("), percent, F.lit("%)")), grouped_number(n)
    )


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("< 0.001")).otherwise(plain_number(half_up(p, 3)))


def numeric_summary(median: Column, q1: Column, q3: Column, mean: Column, sd: Column, unit: Column) -> Column:
    """Median (IQR) and mean (SD) in one line; ``unit`` is empty text where none is stated."""
    return F.when(median.isNull(), F.lit("no readable numbers")).otherwise(
        F.concat(
            F.lit("median "), plain_number(median), F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise(F.lit("")),
            F.lit(" (IQR "), plain_number(q1), F.lit("–"), plain_number(q3), F.lit("); mean "), plain_number(mean),
            F.lit(" (SD "), F.coalesce(plain_number(sd), F.lit("n/a")), F.lit(")"),
        )
    )
