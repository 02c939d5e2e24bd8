"""Lists in cells, long to wide, wide to long."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, split_list, trimmed
from .cells import key_of, row_order, text_of


def split_rows(df: DataFrame, column: str) -> DataFrame:
    """One row per item of a list cell; an empty cell gives one null row."""
    item = F.explode(split_list(quoted(column))).alias("__item")
    return df.select("*", item).select(*[
        F.col("__item").alias(c) if c == column else quoted(c) for c in df.columns
    ])


@dataclass(frozen=True)
class Paired:
    """Rows after pairing, and rows whose two lists differ in length."""

    rows: DataFrame
    mismatched: DataFrame


def explode_paired(df: DataFrame, x: str, y: str) -> Paired:
    """Two list cells to one row per pair; lists of one item or none stay as they are (R2)."""
    items = lambda c: F.filter(
        F.transform(F.split(F.coalesce(text_of(df, c), F.lit("")), "[,;]"), trimmed), lambda v: v != ""
    )
    listed = df.withColumns({"__x": items(x), "__y": items(y)})
    short = (F.size("__x") <= 1) & (F.size("__y") <= 1)
    pairs = F.when(short, F.array(F.struct(text_of(df, x).alias("__x"), text_of(df, y).alias("__y")))).otherwise(
        F.arrays_zip("__x", "__y")
    )
    fits = short | (F.size("__x") == F.size("__y"))
    exploded = listed.filter(fits).select(*[quoted(c) for c in df.columns], F.explode(pairs).alias("__p"))
    rows = exploded.select(*[
        F.col(f"__p.{'__x' if c == x else '__y'}").alias(c) if c in (x, y) else quoted(c) for c in df.columns
    ])
    return Paired(rows, listed.filter(~fits).select(*[quoted(c) for c in df.columns]))


@dataclass(frozen=True)
class Wide:
    """One row per id, and how many values were overwritten by a later row."""

    rows: DataFrame
    collisions: DataFrame


def long_to_wide(df: DataFrame, id_column: str, key: str, value: str, order_by, keys: list[str] | None = None) -> Wide:
    """One column per key value; the later row wins.

    ``keys`` names the columns to make.  Without it they are listed by one job,
    under Spark's own ``spark.sql.pivotMaxValues`` bound on pivot columns.
    """
    at = row_order(order_by)
    name = F.coalesce(text_of(df, key), F.lit("null"))
    rows = df.filter(quoted(id_column).isNotNull()).select(
        key_of(df, id_column).alias("__id"), quoted(id_column).alias("__label"),
        F.when(name == id_column, F.concat(name, F.lit(" (value)"))).otherwise(name).alias("__key"),
        quoted(value).alias("__value"), at.alias("__at"),
    )
    latest = rows.groupBy("__id", "__key").agg(
        F.max_by("__value", "__at").alias("__value"), F.count(F.lit(1)).alias("__n"),
        F.min_by("__label", "__at").alias("__label"), F.min("__at").alias("__at"),
    )
    wide = latest.groupBy("__id").pivot("__key", keys).agg(F.first("__value"))
    labels = latest.groupBy("__id").agg(F.min_by("__label", "__at").alias("__label"))
    made = [c for c in wide.columns if c != "__id"]
    joined = labels.join(wide, "__id").select(F.col("__label").alias(id_column), *[quoted(c) for c in made])
    return Wide(joined, latest.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("collisions")))


def wide_to_long(
    df: DataFrame, id_column: str, columns: list[str], key_name: str = "measure", value_name: str = "value"
) -> DataFrame:
    """One row per filled cell of ``columns``."""
    entries = F.array(*[
        F.struct(F.lit(c).alias(key_name), text_of(df, c).alias(value_name)) for c in columns
    ])
    long = df.select(quoted(id_column), F.inline(entries))
    return long.filter(F.coalesce(trimmed(quoted(value_name)) != "", F.lit(False)))
