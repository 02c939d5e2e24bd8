"""Schema-aware access to cells.

Text columns go through the text rules; typed columns skip them, so a typed
column keeps its pushdown and codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import plain_number
from ..functions.numbers import to_number
from ..functions.text import fold_key, is_blank, is_missing, quoted


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.StringType, T.VarcharType, T.CharType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def key_of(df: DataFrame, name: str) -> Column:
    """What two cells are compared by."""
    return fold_key(quoted(name)) if is_text(df, name) else quoted(name)


def number_of(df: DataFrame, name: str) -> Column:
    """The readable number of a cell, or null."""
    if is_text(df, name):
        return to_number(quoted(name))
    if not is_numeric(df, name):
        return F.lit(None).cast("double")
    number = quoted(name).cast("double")
    if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return number


def text_of(df: DataFrame, name: str) -> Column:
    """The cell as text: whole numbers without ``.0``, dates as ISO text."""
    c = quoted(name)
    kind = data_type(df, name)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return plain_number(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        midnight = F.date_trunc("day", c).cast("timestamp") == c.cast("timestamp")
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm"))
    return c.cast("string")


def blank_of(df: DataFrame, name: str) -> Column:
    return is_blank(quoted(name)) if is_text(df, name) else quoted(name).isNull()


def missing_of(df: DataFrame, name: str) -> Column:
    return is_missing(quoted(name)) if is_text(df, name) else quoted(name).isNull()


def row_order(order_by: str | list[str]) -> Column:
    """One orderable value per row: a single column as it is, several as a struct."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return quoted(names[0]) if len(names) == 1 else F.struct(*[quoted(n) for n in names])


def cells(df: DataFrame, columns: list[str], **keep: Column) -> DataFrame:
    """One row per (column, value) cell, values as text, without a shuffle."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value")) for c in columns
    ])
    return df.select(*[c.alias(n) for n, c in keep.items()], F.inline(entries))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, keeping one copy of the keys."""
    if not keys:
        raise ValueError("join_on needs keys")
    renamed = right.select(
        *[quoted(k).alias(f"__r{i}") for i, k in enumerate(keys)],
        *[quoted(c) for c in right.columns if c not in keys],
    )
    same = [quoted(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, same, how).drop(*[f"__r{i}" for i in range(len(keys))])


def shared(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` (all of them by default) kept alive in every branch that reads it.

    Spark computes a shuffle once for all branches only while they ask for the
    same columns; pruning would give each branch a shuffle, and a scan, of its
    own.  The test is always true, which the optimizer cannot know.  Branches
    must also not filter on grouping keys, since such filters move below the
    grouping; they decide inside their aggregates instead.
    """
    return df.filter(F.xxhash64(*[quoted(c) for c in columns or df.columns]) >= F.lit(-(2**63)))
