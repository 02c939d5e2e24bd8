"""A small sample to show around: some columns withheld, the rest masked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask_number_text, mask_string
from ..functions.text import quoted
from ..operators.cells import is_numeric, is_temporal, is_text, row_order, text_of

SAMPLE_ROWS = 10
WITHHELD = "[withheld]"


def mask_column(df: DataFrame, column: str, order_by, seed: int = 1):
    """A look-alike for every cell, drawn from seed, row and column, never from the value."""
    drawn = F.xxhash64(F.lit(seed), F.lit(column), row_order(order_by))
    if is_numeric(df, column):
        return mask_number_text(text_of(df, column), drawn).cast(df.schema[column].dataType)
    if is_text(df, column) or is_temporal(df, column):
        return mask_string(text_of(df, column), drawn)
    return quoted(column)


def masked_sample(df: DataFrame, order_by, withheld: list[str] = (), rows: int = SAMPLE_ROWS, seed: int = 1) -> DataFrame:
    """The first rows in order, masked; withheld columns show only that they exist."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    head = df.orderBy(*[quoted(o) for o in order]).limit(rows)
    return head.select(*[
        (F.lit(WITHHELD) if c in withheld else mask_column(df, c, order_by, seed)).alias(c)
        for c in df.columns if c not in order
    ])
