"""Column types, profiles and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import ISO_PREFIX
from ..functions.formats import plain_number
from ..functions.numbers import NUMBER, half_up, is_number_text, to_number, without_noise
from ..functions.text import entity_key, fold_key, is_blank, is_marker
from .cells import cells, is_text, row_order, shared

# The classes of a column, and the limits of the role tests.
EMPTY, NUMBER_TYPE, BOOLEAN, DATE, MIXED, TEXT = (
    "empty", "number", "true/false", "date", "mixed (text + numbers)", "text",
)
NUMBER_AS_TEXT = "number (stored as text)"
GROUPING_MAX_DISTINCT = 10
AXIS_MAX_DISTINCT = 12
AXIS_MAX_UNIQUE = 0.8


def value_frequencies(df: DataFrame, columns: list[str] | None = None, **keep: Column) -> DataFrame:
    """``column, value, n`` for every distinct cell value, nulls included.

    The one shuffle that the scan and the profile share: cells are counted in
    every task first, and all text rules then run once per distinct value.
    """
    return shared(cells(df, columns or df.columns, **keep).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(k).alias(k) for k in keep]
    ))


def declared_type(df: DataFrame, column: str) -> str | None:
    """The class a typed column has by its schema; None for text."""
    kind = df.schema[column].dataType
    if is_text(df, column):
        return None
    if isinstance(kind, T.NumericType):
        return NUMBER_TYPE
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return TEXT


def declared_types(df: DataFrame, columns: list[str]) -> Column:
    """The declared class of the row's ``column``, null for text."""
    pairs = [x for c in columns for x in (F.lit(c), F.lit(declared_type(df, c)).cast("string"))]
    return F.element_at(F.create_map(*pairs), F.col("column"))


def class_counts() -> list[Column]:
    """Weighted counts over ``value, n`` that decide a text column's class."""
    v, n = F.col("value"), F.col("n")
    plain = F.coalesce(v.rlike(NUMBER), F.lit(False))
    iso = F.coalesce(v.rlike(ISO_PREFIX), F.lit(False))
    count = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return [
        F.sum("n").alias("rows"), count(v.isNotNull() & ~is_blank(v)).alias("filled"),
        count(plain).alias("numbers"), count(iso).alias("iso_dates"), count(is_marker(v)).alias("markers"),
        count(is_number_text(v) & ~is_blank(v)).alias("number_texts"),
    ]


def class_of(declared: Column) -> Column:
    """The class of a column from its declared type or its counts."""
    filled = F.col("filled")
    return (
        F.when(filled == 0, F.lit(EMPTY))
        .when(declared.isNotNull(), declared)
        .when(F.col("numbers") == filled, F.lit(NUMBER_TYPE))
        .when((F.col("iso_dates") > 0) & (F.col("iso_dates") + F.col("markers") == filled), F.lit(DATE))
        .when(F.col("numbers") > 0, F.lit(MIXED))
        .otherwise(F.lit(TEXT))
    )


def infer_types(df: DataFrame, columns: list[str] | None = None, window: int | None = None, order_by=None) -> DataFrame:
    """``column, type`` for every column.

    The whole table decides; ``window`` limits the look to the first rows of ``order_by``.
    ``is_numeric`` is the looser test: a number or mixed class, or every value
    readable as a number.
    """
    columns = columns or df.columns
    if window and order_by is None:
        raise ValueError("a window of rows needs order_by")
    rows = df.orderBy(row_order(order_by)).limit(window) if window else df
    v, n = F.col("value"), F.col("n")
    counts = cells(rows, columns).withColumn("n", F.lit(1)).groupBy("column").agg(
        *class_counts(), F.coalesce(F.sum(F.when(v.try_cast("double").isNotNull(), n)), F.lit(0)).alias("castable")
    )
    typed = counts.withColumn("type", class_of(declared_types(df, columns)))
    loose = F.col("type").isin(NUMBER_TYPE, MIXED) | ((F.col("filled") > 0) & (F.col("castable") == F.col("filled")))
    return typed.select("column", "type", loose.alias("is_numeric"))


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns the looser numeric test accepts; reads one row per column."""
    return [r["column"] for r in infer_types(df, columns).filter("is_numeric").collect()]


def profile(df: DataFrame, order_by, columns: list[str] | None = None, sample_rows: int | None = None) -> DataFrame:
    """One row per column: class, filled percent, distinct, range or top three."""
    columns = columns or [c for c in df.columns if c not in ([order_by] if isinstance(order_by, str) else order_by)]
    rows = df.orderBy(row_order(order_by)).limit(sample_rows) if sample_rows else df
    values = value_frequencies(rows, columns, first=row_order(order_by))
    v, n = F.col("value"), F.col("n")
    number = to_number(v)
    facts = values.groupBy("column").agg(*class_counts(), F.min(number).alias("lo"), F.max(number).alias("hi"))
    distinct = values.select("column", F.when(~is_blank(v), entity_key(v)).alias("k")).groupBy("column").agg(
        F.count_distinct("k").alias("distinct")
    )
    by_count = Window.partitionBy("column").orderBy(F.asc("blank"), F.desc("n"), F.asc("first"))
    ranked = values.withColumn("blank", is_blank(v)).withColumn("rn", F.row_number().over(by_count))
    top = ranked.filter((F.col("rn") <= 3) & ~F.col("blank")).groupBy("column").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "value", "n"))),
            lambda t: F.concat(t["value"], F.lit(" ("), t["n"].cast("string"), F.lit(")")),
        ), ", ").alias("top")
    )
    base = facts.join(distinct, "column", "left").join(top, "column", "left").withColumn(
        "class", class_of(declared_types(df, columns))
    )
    as_text = F.col("class").isin(TEXT, MIXED) & (F.col("filled") > 0) & (F.col("number_texts") == F.col("filled"))
    span = F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("constant: "), plain_number(F.col("lo")))).otherwise(
        F.concat(plain_number(F.col("lo")), F.lit(" – "), plain_number(F.col("hi")))
    )
    typed = base.withColumn("type", F.when(as_text, F.lit(NUMBER_AS_TEXT)).otherwise(F.col("class")))
    numeric = F.col("type").isin(NUMBER_TYPE, NUMBER_AS_TEXT)
    return typed.select(
        "column", "type",
        F.coalesce(half_up(F.col("filled") / F.col("rows") * 100), F.lit(0)).cast("int").alias("filled_pct"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.when(F.col("filled") == 0, F.lit("empty column")).when(numeric, span).otherwise(F.col("top")).alias("summary"),
        (F.col("filled") == 0).alias("is_empty"),
        ((F.coalesce("distinct", F.lit(0)) == 1) & (F.col("filled") > 0)).alias("is_constant"),
        F.col("rows"), F.col("filled"),
    )


def column_roles(profiled: DataFrame, columns: list[str]) -> DataFrame:
    """Per column a badge and whether it suits grouping or an outcome."""
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    numeric = F.col("type").isin(NUMBER_TYPE, NUMBER_AS_TEXT)
    values = F.concat(F.lit("text · "), F.col("distinct").cast("string"), F.lit(" value"),
                      F.when(F.col("distinct") == 1, F.lit("")).otherwise(F.lit("s")))
    badge = F.when(F.col("is_empty"), F.lit("empty")).when(numeric, F.col("type")).otherwise(values)
    return profiled.select(
        "column", badge.alias("badge"),
        (~numeric & F.col("distinct").between(2, GROUPING_MAX_DISTINCT)).alias("suits_grouping"),
        numeric.alias("suits_outcome"),
        (
            ~numeric & (F.col("filled") >= 2) & (F.col("distinct") <= AXIS_MAX_DISTINCT)
            & (F.col("distinct") / F.when(F.col("filled") > 0, F.col("filled")) < AXIS_MAX_UNIQUE)
        ).alias("suits_axis"),
        F.element_at(place, F.col("column")).alias("position"),
    )


def role_order(roles: DataFrame, role: str) -> DataFrame:
    """Columns that suit ``role`` first, both parts in table order."""
    return roles.orderBy(F.desc(f"suits_{role}"), "position")
