"""Sets of tables: write them out, describe them again after a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import safe_table_names
from ..functions.text import quoted
from ..operators.cells import row_order
from ..operators.profile import infer_types, value_frequencies

SAMPLES = 4


def write_tables(tables: dict[str, DataFrame], folder: str, headers: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write every table with its own column order; returns name to path."""
    out = {}
    for (name, df), safe in zip(tables.items(), safe_table_names(list(tables))):
        columns = (headers or {}).get(name) or df.columns
        out[name] = f"{folder.rstrip('/')}/{safe}"
        df.select(*[quoted(c) for c in columns]).write.mode("overwrite").parquet(out[name])
    return out


def describe_columns(df: DataFrame, order_by, window: int | None = None) -> DataFrame:
    """Class and up to four first-seen samples per column."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = [c for c in df.columns if c not in order]
    rows = df.orderBy(row_order(order_by)).limit(window) if window else df
    values = value_frequencies(rows, columns, first=row_order(order_by)).filter("value IS NOT NULL")
    seen = Window.partitionBy("column").orderBy("first")
    samples = values.withColumn("rn", F.row_number().over(seen)).filter(F.col("rn") <= SAMPLES).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]).alias("samples")
    )
    return infer_types(rows, columns).join(samples, "column", "left").select("column", "type", "samples")


def surviving_vocabulary(vocab: DataFrame, columns: list[str]) -> DataFrame:
    """The vocabulary of the columns a changed table still has."""
    return vocab.filter(F.col("column").isin(*columns))
