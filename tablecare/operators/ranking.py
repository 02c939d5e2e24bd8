"""Top-N with ties, rankings, sorted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import share
from ..functions.text import quoted
from .aggregate import pooled_counts, value_counts
from .cells import blank_of, is_text, key_of, number_of, row_order, shared
from .conditions import Condition, keep
from .numbering import number_rows


def top_with_ties(
    df: DataFrame, value: str, n: int | None, least: bool = False, whole: Column | None = None
) -> DataFrame:
    """The ``n`` best rows and every row tied with the last of them (W2); all rows where ``whole`` holds.

    The cutoff is found by a top-n that keeps ``n`` rows per task, and applied
    as a filter, so ties of any number stay spread over the cluster.
    """
    if n is None:
        return df
    best = df.select(value).orderBy(F.asc(value) if least else F.desc(value)).limit(n)
    cutoff = best.agg(F.max(value) if least else F.min(value)).scalar()
    good = F.col(value) <= cutoff if least else F.col(value) >= cutoff
    return df.filter(good if whole is None else good | whole)


def _best_first(value: str, least: bool) -> list[Column]:
    return [F.asc(value) if least else F.desc(value), F.asc("first")]


def top_frequency(
    df: DataFrame, column: str, order_by, n: int | None = None, least: bool = False,
    conditions: list[Condition] = (),
) -> DataFrame:
    """Most or least common values, n (%) of the rows that have one."""
    rows = keep(df, list(conditions))
    counts = shared(value_counts(rows, column, order_by))
    filled = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    ranked = top_with_ties(counts, "n", n, least)
    return ranked.select("label", "n", share(F.col("n"), filled).alias("share_pct"), "first").orderBy(
        *_best_first("n", least)
    )


def top_pooled(
    df: DataFrame, columns: list[str], order_by, policy: str = "occurrence", entity: str | None = None,
    n: int | None = None, least: bool = False, conditions: list[Condition] = (),
) -> DataFrame:
    """A ranking over several pooled columns, n (%) of all mentions (A16 + W2)."""
    counts = pooled_counts(keep(df, list(conditions)), columns, order_by, policy, entity)
    mentions = counts.agg(F.sum("n")).scalar()
    ranked = top_with_ties(counts, "n", n, least)
    return ranked.select("label", "n", share(F.col("n"), mentions).alias("share_pct"), "first").orderBy(
        *_best_first("n", least)
    )


def top_magnitude(
    df: DataFrame, column: str, order_by, n: int | None = None, least: bool = False,
    conditions: list[Condition] = (),
) -> DataFrame:
    """Whole rows ranked by a number, unreadable ones left out; ``Rank`` is 1, 2, 3."""
    rows = keep(df, list(conditions)).withColumn("__x", number_of(df, column)).filter(F.col("__x").isNotNull())
    best = top_with_ties(rows, "__x", n, least)
    order = [F.asc("__x") if least else F.desc("__x"), row_order(order_by).asc()]
    return number_rows(best, order, "Rank").drop("__x").select("Rank", *df.columns)


def unreadable_count(df: DataFrame, column: str) -> DataFrame:
    """Rows a magnitude ranking leaves out."""
    return df.agg(F.count_if(number_of(df, column).isNull()).alias("unreadable"))


def sort_columns(df: DataFrame, column: str, order_by, descending: bool = False) -> list[Column]:
    """Blanks last; numbers in number order before text in folded order; then row order (O1)."""
    way = Column.desc_nulls_last if descending else Column.asc_nulls_last
    if is_text(df, column):
        number = number_of(df, column)
        keys = [number, F.when(number.isNull() & ~blank_of(df, column), key_of(df, column))]
    else:
        keys = [quoted(column)]
    return [blank_of(df, column).asc(), *[way(k) for k in keys], row_order(order_by).asc()]


def sort_rows(df: DataFrame, column: str, order_by, descending: bool = False) -> DataFrame:
    return df.orderBy(*sort_columns(df, column, order_by, descending))


def list_rows(
    df: DataFrame, conditions: list[Condition], order_by, entity: str | None = None,
    sort: tuple[str, bool] | None = None,
) -> DataFrame:
    """Matching rows, optionally the first per entity, optionally sorted.

    Rows without an entity share one place in the list.
    """
    rows = keep(df, conditions)
    if entity:
        key = F.coalesce(key_of(rows, entity).cast("string"), F.lit(""))
        first = Window.partitionBy(key).orderBy(row_order(order_by))
        rows = rows.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")
    return sort_rows(rows, sort[0], order_by, sort[1]) if sort else rows

