"""Positions and running totals over a whole table without putting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _placed(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """``df`` sorted over all partitions, each row with its partition and place.

    The sorted rows are written to the checkpoint folder, so every later read
    sees the same layout, also after an executor is lost.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut_lineage(
        df.orderBy(*order_by).select("*", F.spark_partition_id().alias("__part"), inside.alias("__pos"))
    )


def _shifts(placed: DataFrame, **totals: Column) -> DataFrame:
    """Per partition, the totals of all partitions before: one row per partition."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    return sums.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals])


def number_rows(df: DataFrame, order_by: list[Column], name: str, start: int = 1) -> DataFrame:
    """Add ``name`` = start, start + 1, ... in the order of ``order_by``.

    Rows are numbered inside their sorted partition and shifted by the sizes of
    the partitions before it; the broadcast table has one row per partition.
    """
    placed = _placed(df, order_by)
    shifts = _shifts(placed, __shift=F.lit(1))
    return placed.join(F.broadcast(shifts), "__part").select(
        *df.columns, (F.col("__pos") + F.col("__shift") + F.lit(start)).alias(name)
    )


def running_total(df: DataFrame, order_by: list[Column], value: str, name: str, position: str) -> DataFrame:
    """Add the running sum of ``value`` and the 1-based position in ``order_by``."""
    placed = _placed(df, order_by)
    shifts = _shifts(placed, __shift=F.lit(1), __sum=F.col(value))
    up_to = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(shifts), "__part").select(
        *df.columns,
        (F.sum(value).over(up_to) + F.col("__sum")).alias(name),
        (F.col("__pos") + F.col("__shift") + F.lit(1)).alias(position),
    )
